"""Sinks: tables, sharded result caches with their manifest, text tables with metadata lines, JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_track(df: DataFrame, path: str, meta: dict | None = None, text: bool = False) -> None:
    """A track as Parquet by chromosome, or as tab-separated text; metadata goes to a table of one row beside it."""
    if text:
        df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    else:
        df.write.mode("overwrite").partitionBy("chrom").parquet(path)
    if meta:
        df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + ".meta")


def write_beagle(gl: DataFrame, path: str) -> None:
    """Likelihoods (chrom, pos, sample_idx, gl0, gl1, gl2) as text in the likelihood format, a file for each chromosome, sites in order."""
    names = [r[0] for r in gl.select("sample_idx").distinct().orderBy("sample_idx").collect()]  # as many as samples
    head = "\t".join(["marker", "allele1", "allele2", *[f"Ind{i}_{k}" for i in names for k in range(3)]])
    site = gl.groupBy("chrom", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "gl0", "gl1", "gl2"))), lambda x: F.concat_ws("\t", x["gl0"].cast("string"), x["gl1"].cast("string"), x["gl2"].cast("string"))).alias("g"))
    rows = site.select("chrom", "pos", F.concat_ws("\t", F.concat_ws("_", "chrom", "pos"), F.lit("0"), F.lit("1"), F.concat_ws("\t", "g")).alias("value"))
    heads = site.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("pos"), F.lit(head).alias("value"))
    rows.unionByName(heads).repartition("chrom").sortWithinPartitions("chrom", "pos").select("chrom", "value").write.mode("overwrite").partitionBy("chrom").text(path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Sequences (name, seq) as records of lines of `width` letters."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, order: str, values: str) -> None:
    """Rows of numbers (chrom, an order, an array) as text without a header, a file for each chromosome, rows in order."""
    rows = df.select("chrom", order, F.array_join(F.transform(values, lambda x: x.cast("string")), " ").alias("value"))
    rows.repartition("chrom").sortWithinPartitions("chrom", order).select("chrom", "value").write.mode("overwrite").partitionBy("chrom").text(path)


def write_cache(df: DataFrame, path: str, k: int, sample_set: str) -> None:
    """Results by K, sample set and chromosome; only the partitions that df holds are replaced."""
    df.withColumn("K", F.lit(k)).withColumn("sample_set", F.lit(sample_set)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("K", "sample_set", "chrom").parquet(path)


def read_cache(spark: SparkSession, path: str, k: int, sample_set: str, chrom: str | None = None, canonical: int | None = None) -> DataFrame:
    """A cached result: of the sample set, else of any set of that K, else (for the canonical K) of all. Partitions are pruned."""
    t = spark.read.parquet(path)
    if chrom is not None:
        t = t.filter(F.col("chrom") == chrom)
    for found in (t.filter((F.col("K") == k) & (F.col("sample_set") == sample_set)), t.filter(F.col("K") == k), t if k == canonical else None):
        if found is not None and not found.isEmpty():
            return found
    return t.limit(0)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose keys new has not; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Results of several chromosomes under each other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def wide(df: DataFrame, rows: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """A long table with one column for each given name."""
    return df.groupBy(*rows).pivot(column, names).agg(F.first(value))


def write_wide(df: DataFrame, path: str, part: str, row: str, column: str, value: str, missing: str = "NA", compression: str = "none") -> None:
    """A long table as matrices of text: a file for each `part`, a header with the names in `column`, which are found in the table, and
    lines in the order of `row`. Cells without a row or with a null hold `missing`; rows without a name have no cell. An empty table writes no file."""
    df = df.filter(F.col(column).isNotNull())
    names = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]  # as many as the matrix has columns
    cells = [f"_{i}" for i in range(len(names))]
    w = wide(df, [part, row], column, names, value).toDF("_part", "_row", *cells)
    body = w.select("_part", F.lit(1).alias("_o"), "_row", F.concat_ws("\t", F.col("_row").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in cells]).alias("value"))
    heads = df.select(F.col(part).alias("_part")).distinct().select("_part", F.lit(0).alias("_o"), F.lit(None).cast(dict(w.dtypes)["_row"]).alias("_row"), F.lit("\t".join([row, *map(str, names)])).alias("value"))
    ordered = body.unionByName(heads).repartition("_part").sortWithinPartitions("_part", "_o", "_row")
    ordered.select(F.col("_part").alias(part), "value").write.mode("overwrite").option("compression", compression).partitionBy(part).text(path)


#: Rows up to which a result is put into one document.
MOST_ROWS = 100_000


def document(df: DataFrame, statistic: str, request_id: str | None = None, meta: dict | None = None) -> str:
    """A result as a JSON document with status ok or empty, of at most MOST_ROWS rows; write_document takes larger ones."""
    found = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: ask for a path")
    rows = [json.loads(r[0]) for r in found]
    return json.dumps({"statistic": statistic, "request_id": request_id, "status": "ok" if rows else "empty", "meta": meta or {}, "rows": rows})


def write_document(df: DataFrame, path: str, statistic: str, request_id: str | None = None, meta: dict | None = None) -> str:
    """The same for results of any size: rows go to JSON lines below path, and the document says where."""
    rows = f"{path.rstrip('/')}/rows"
    df.write.mode("overwrite").option("ignoreNullFields", False).json(rows)
    status = "empty" if df.sparkSession.read.text(rows).isEmpty() else "ok"
    return json.dumps({"statistic": statistic, "request_id": request_id, "status": status, "meta": meta or {}, "rows_path": rows})


def strips(df: DataFrame, labels: list[str], label: str = "structure_class") -> DataFrame:
    """Rows with the colour of their label."""
    from lociflow.operators.ancestry import label_colour

    return df.withColumn("colour", label_colour(F.col(label), labels))
