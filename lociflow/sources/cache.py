"""Results that are computed once for each chromosome and kept, with a manifest of versions.

A cache is a folder with `data/<id>` (results, a folder for each call that computed something) and `manifest/version=N` (which data hold a
chromosome in that version). Data are written before the manifest that names them, and a manifest is a whole table of its own: a call that
dies leaves the last version as it was. Later data may have more columns; what earlier ones lack is null."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "K int, sample_set string, chrom string, data string, n_rows long, since int"


class Cache:
    """Results by K, sample set and chromosome. Manifests have a row for each chromosome and are read by the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(at) if fs.exists(at) else []
        whole = [x.getPath() for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def entries(self, version: int | None = None) -> dict[tuple[int, str, str], dict]:
        """(K, sample set, chromosome) -> entry of a version, the last one without."""
        known = self._versions()
        if not known:
            return {}
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/version={version or known[-1]}").collect()
        return {(r["K"], r["sample_set"], r["chrom"]): r.asDict() for r in rows}

    def put(self, df: DataFrame, k: int, sample_set: str) -> int:
        """The rows of df replace those of its chromosomes. Returns the new version."""
        name, entries = uuid.uuid4().hex, self.entries()
        version = (self._versions() or [0])[-1] + 1
        df.write.partitionBy("chrom").parquet(f"{self.path}/data/{name}")
        for r in self.spark.read.parquet(f"{self.path}/data/{name}").groupBy(F.col("chrom").cast("string").alias("chrom")).count().collect():
            entries[k, sample_set, r["chrom"]] = {"K": k, "sample_set": sample_set, "chrom": r["chrom"], "data": name, "n_rows": r["count"], "since": version}
        self.spark.createDataFrame([tuple(e.values()) for e in entries.values()], ENTRY).coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")
        return version

    def read(self, k: int, sample_set: str, chroms: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of these chromosomes (all without), with `since`, the version that brought them; None if there are none. Only their folders
        are read."""
        where: dict[tuple[str, int], list[str]] = {}
        for (kk, s, c), e in self.entries(version).items():
            if (kk, s) == (k, sample_set) and (chroms is None or c in chroms):
                where.setdefault((e["data"], e["since"]), []).append(c)
        out = None
        for (data, since), own in sorted(where.items(), key=lambda x: x[0][1]):
            one = self.spark.read.parquet(f"{self.path}/data/{data}").withColumn("chrom", F.col("chrom").cast("string")).filter(F.col("chrom").isin(own)).withColumn("since", F.lit(since))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def get(self, k: int, sample_set: str, chroms: list[str], compute: Callable[[list[str]], DataFrame]) -> DataFrame:
        """The rows of these chromosomes; compute is called for those that the cache lacks, and for them alone."""
        have = {c for kk, s, c in self.entries() if (kk, s) == (k, sample_set)}
        missing = [c for c in chroms if c not in have]
        if missing:
            self.put(compute(missing), k, sample_set)
        return self.read(k, sample_set, chroms)
