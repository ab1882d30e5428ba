"""Homology hits: order, counts, filtered top hits, lookups; registries of intervals, samples and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators.windows import points_in, site_windows


#: Ranges of names in which genes are numbered, and names that their bounds are drawn from.
RANGES, DRAWN = 200, 20_000


def gene_records(hits: DataFrame) -> DataFrame:
    """Genes in order of name with the place of their first hit and the number of hits. Names are dealt into ranges by bounds from a
    bounded draw, so that a gene's range depends on its name alone, and hits are counted on through the ranges' totals."""
    g = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"))
    drawn = sorted(r[0] for r in g.filter("query is not null").select("query", F.xxhash64("query").alias("h")).orderBy("h").limit(DRAWN).select("query").collect())
    bounds = F.array(*[F.lit(drawn[i * len(drawn) // RANGES]) for i in range(1, RANGES)] if len(drawn) >= RANGES else [F.lit(x) for x in drawn]).cast("array<string>")
    at = g.withColumn("_p", F.size(F.filter(bounds, lambda b: b <= F.col("query"))))
    before = at.groupBy("_p").agg(F.sum("n_hits").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each range
    run = F.sum("n_hits").over(Window.partitionBy("_p").orderBy("query"))
    return at.withColumn("_r", run).join(F.broadcast(before), "_p").select("query", (F.col("_b") + F.col("_r") - F.col("n_hits")).alias("first_hit"), "n_hits")


#: Hits of a file of an index: what one task sorts.
HITS = 2_000_000


def write_index(hits: DataFrame, path: str, files: int = 16, most: int = HITS) -> None:
    """Hits in ranges of gene names (`files`, or more so that one holds about `most` hits), sorted by gene, bitscore and identity (O02) with bloom filters of the names, and a manifest
    of the files' first and last names. A gene with very many hits may lie in one range alone."""
    data = f"{path.rstrip('/')}/data"
    files = max(files, -(-hits.count() // most))
    ranged = hits.repartitionByRange(files, "query").sortWithinPartitions("query", F.desc("bitscore"), F.desc("identity"))
    ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled#query", "true").option("parquet.bloom.filter.expected.ndv#query", "100000").parquet(data)
    stored = hits.sparkSession.read.parquet(data)
    stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("query").alias("first"), F.max("query").alias("last"), F.count(F.lit(1)).alias("n_hits")).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")


def files_of(spark: SparkSession, path: str, genes: DataFrame) -> list[str]:
    """The files of an index whose range of names holds one of the genes (query): at most as many as the index has."""
    manifest = spark.read.parquet(f"{path.rstrip('/')}/manifest")
    ranges = F.broadcast(manifest.agg(F.sort_array(F.collect_list(F.struct("first", "last", "file"))).alias("r")))
    hit = genes.select("query").crossJoin(ranges).select(F.explode(F.filter("r", lambda x: (x["first"] <= F.col("query")) & (F.col("query") <= x["last"]))["file"]).alias("file"))
    return sorted(r[0] for r in hit.distinct().collect())


def lookup_many(spark: SparkSession, path: str, genes: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """J23, K11 for a table of genes (query): query, found, n_hits_total, n_hits_emitted, and the best hits in order (rank, target, bitscore,
    identity, source_type, hit_id; null where there is none). Only files whose names may hold a gene are opened."""
    wanted = genes.select("query").distinct()
    files = files_of(spark, path, wanted)
    schema = spark.read.parquet(f"{path.rstrip('/')}/data").schema
    own = (spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)).join(wanted, "query", "left_semi")
    total = own.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits_total"))
    best = top_hits(own, limit, **filters)
    emitted = best.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits_emitted"))
    known = wanted.join(total, "query", "left").join(emitted, "query", "left")
    rows = known.select("query", F.col("n_hits_total").isNotNull().alias("found"), F.coalesce("n_hits_total", F.lit(0)).alias("n_hits_total"), F.coalesce("n_hits_emitted", F.lit(0)).alias("n_hits_emitted"))
    return rows.join(best.select("query", "rank", "target", "bitscore", "identity", "source_type", "hit_id"), "query", "left")


def top_hits(hits: DataFrame, limit: int | None = None, source: str | None = None, min_identity: float | None = None, min_bitscore: float | None = None) -> DataFrame:
    """Hits of each gene that pass the filters, the best `limit` by bitscore and identity (then target and id); rank from 1. A limit of 0
    gives none, no limit gives all. A hit without a score (-1) passes a bitscore filter no more than others below it."""
    h = hits
    if source is not None:
        h = h.filter(F.col("source_type") == source)
    if min_identity is not None:
        h = h.filter(F.col("identity") >= min_identity)
    if min_bitscore is not None:
        h = h.filter(F.col("bitscore") >= min_bitscore)
    r = h.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bitscore"), F.desc("identity"), "target", "hit_id")))
    return r if limit is None else r.filter(F.col("rank") <= limit)


def orthologs(hits: DataFrame) -> DataFrame:
    """Hits of the genome aligner."""
    return hits.filter(F.col("source_type") == "miniprot")


def paralogs(hits: DataFrame) -> DataFrame:
    """Hits of the protein aligner but a gene's hit on itself."""
    return hits.filter((F.col("source_type") == "diamond") & (F.col("query") != F.col("target")))


def lookup(hits: DataFrame, gene: str, limit: int | None = None, **filters) -> dict:
    """The response to a lookup: query, found, n_hits_total, n_hits_emitted, hits."""
    own = hits.filter(F.col("query") == gene)
    total = own.count()
    rows = [r.asDict() for r in top_hits(own, limit, **filters).orderBy("rank").collect()]
    return {"query": gene, "found": total > 0, "n_hits_total": total, "n_hits_emitted": len(rows), "hits": rows}


def interval_registry(sites: DataFrame, candidates: DataFrame, width: int = 100, step: int = 20) -> DataFrame:
    """Intervals with numbers of markers: the genome, chromosomes, windows of sites (half-open ends after the last site), candidates."""
    s = sites.select("chrom", "pos").distinct()
    genome = s.agg(F.lit("genome").alias("kind"), F.lit("genome").alias("name"), F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.count(F.lit(1)).alias("n_markers"))
    chroms = s.groupBy("chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_markers")).select(F.lit("chromosome").alias("kind"), F.col("chrom").alias("name"), "chrom", "start", "end", "n_markers")
    w = site_windows(s, width, step, ["pos"]).groupBy("chrom", "window_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n_markers")).select(F.lit("snp_window").alias("kind"), F.concat_ws("_", "chrom", "window_id").alias("name"), "chrom", "start", "end", "n_markers")
    n = points_in(s, candidates.select("chrom", "start", "end", "candidate_id"), 100_000).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    c = candidates.join(n, "candidate_id", "left").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("name"), "chrom", "start", "end", F.coalesce("n", F.lit(0)).alias("n_markers"))
    return genome.unionByName(chroms).unionByName(w).unionByName(c)


def sample_subsets(q: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Samples with their cluster (1-based argmax of q, the first on ties), for all and for the samples that `pruned` keeps."""
    full = q.select(F.lit("all").alias("subset"), "sample_idx", F.array_position("q", F.array_max("q")).cast("int").alias("cluster"))
    return full if pruned is None else full.unionByName(full.join(pruned, "sample_idx", "left_semi").withColumn("subset", F.lit("pruned")))


def filter_samples(rows: DataFrame, keep: DataFrame | None = None, exclude: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """Rows of the samples in keep (if given) that are not in exclude."""
    if keep is not None:
        rows = rows.join(keep, key, "left_semi")
    return rows if exclude is None else rows.join(exclude, key, "left_anti")


class Groups:
    """Named groups of samples. Names are looked up in turn: given lists; ids of a registry (group, sample_id), several parted by commas;
    patterns of registered ids; strategies (functions of the session); and three strategies over tables: precomp_bands (values: sample_id,
    value, perhaps chrom), C01i_decomposition (classes: sample_id, class, perhaps chrom; without them, registered ids inv_..._HOM_REF, HET or
    HOM_INV) and ancestry_clusters (registered ids ancestry_K<k>_Q<i> if there are two, else the argmax of q: sample_id, q)."""

    PREFIXES = ("inv_", "ghsl_", "ancestry_")

    def __init__(self, spark: SparkSession, registry: DataFrame, strategies: dict | None = None, values: DataFrame | None = None, classes: DataFrame | None = None, q: DataFrame | None = None) -> None:
        self.spark, self.registry, self.strategies = spark, registry, strategies or {}
        self.values, self.classes, self.q = values, classes, q

    def _here(self, df: DataFrame, chrom: str | None) -> DataFrame:
        return df.filter(F.col("chrom") == chrom) if chrom is not None and "chrom" in df.columns else df

    def _strategy(self, name: str, chrom: str | None, bands: int) -> DataFrame | None:
        if name in self.strategies:
            return self.strategies[name](self.spark)
        if name == "precomp_bands" and self.values is not None:
            return value_bands(self._here(self.values, chrom), bands, [])
        if name == "C01i_decomposition":
            if self.classes is not None:
                return self._here(self.classes, chrom).filter("class is not null").select(F.col("class").alias("group"), "sample_id")
            known = self.registry.filter(F.col("group").rlike("^inv_.*_(HOM_REF|HET|HOM_INV)$"))
            return known if chrom is None else known.filter(F.col("group").contains(chrom))
        if name == "ancestry_clusters":
            known = self.registry.filter(F.col("group").rlike("^ancestry_K[0-9]+_Q[0-9]+$"))
            if known.select("group").distinct().count() >= 2:
                return known.select(F.regexp_extract("group", "Q[0-9]+$", 0).alias("group"), "sample_id")
            if self.q is not None:
                return clusters_of(self.q)
        return None

    def resolve(self, names: str | list[str] | dict[str, list[str]], chrom: str | None = None, bands: int = 3) -> DataFrame:
        """group, sample_id."""
        if isinstance(names, dict):
            return self.spark.createDataFrame([(g, s) for g, m in names.items() for s in m], "group string, sample_id string")
        wanted = [x.strip() for x in names.split(",")] if isinstance(names, str) else list(names)
        found = None
        for name in wanted:
            part = self.registry.filter(F.col("group") == name)
            if name.startswith(self.PREFIXES) and part.isEmpty():
                pattern = name[:-1] + ".*" if name.endswith(("*", "_")) and not name.endswith(".*") else name
                part = self.registry.filter(F.col("group").rlike(pattern))
            special = self._strategy(name, chrom, bands)
            part = (special if special is not None and part.isEmpty() else part).select("group", "sample_id")
            found = part if found is None else found.unionByName(part)
        if found is None or found.isEmpty():
            raise ValueError(f"no group of samples: {wanted}")
        return found.distinct()


def value_bands(values: DataFrame, bands: int, by: list[str]) -> DataFrame:
    """by..., group (band1, band2, ... from the lowest), sample_id: samples (by..., sample_id, value) parted at the bands - 1 widest gaps between
    neighbouring values (ties: the lower gap). Samples without a value are in no band. Rows are samples, so their number bounds a window."""
    order = Window.partitionBy(*by).orderBy("value", "sample_id") if by else Window.orderBy("value", "sample_id")
    gaps = values.filter("value is not null").withColumn("_g", F.coalesce(F.col("value") - F.lag("value").over(order), F.lit(0.0))).withColumn("_i", F.row_number().over(order))
    widest = Window.partitionBy(*by).orderBy(F.desc("_g"), "_i") if by else Window.orderBy(F.desc("_g"), "_i")
    cut = gaps.withColumn("_c", ((F.row_number().over(widest) < bands) & (F.col("_g") > 0)).cast("int"))
    return cut.select(*by, F.concat(F.lit("band"), (F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("string")).alias("group"), "sample_id")


def clusters_of(q: DataFrame) -> DataFrame:
    """group (Q1, Q2, ...; the argmax of q, the first on ties), sample_id."""
    return q.select(F.concat(F.lit("Q"), F.array_position("q", F.array_max("q")).cast("string")).alias("group"), "sample_id")


def likelihood_shares(gl: DataFrame) -> DataFrame:
    """sample_idx, q: at which share of its sites each of the three genotypes is a sample's likeliest (the first on ties)."""
    best = F.when((F.col("gl0") >= F.col("gl1")) & (F.col("gl0") >= F.col("gl2")), 0).when(F.col("gl1") >= F.col("gl2"), 1).otherwise(2)
    n = F.count(F.lit(1))
    return gl.withColumn("_k", best).groupBy("sample_idx").agg(F.array(*[F.sum((F.col("_k") == k).cast("int")) / n for k in range(3)]).alias("q"))


def karyotypes(gl: DataFrame, width: int) -> DataFrame:
    """chrom, start, sample_idx, group: in every window of `width` positions, which of HOM_A, HET and HOM_B (genotype 0, 1, 2 at all its sites) a
    sample's likelihoods make likeliest, the first on ties."""
    total = F.col("gl0") + F.col("gl1") + F.col("gl2")
    sums = gl.groupBy("chrom", (F.floor(F.col("pos") / width) * width).alias("start"), "sample_idx").agg(*[F.round(F.sum(F.ln(F.greatest(F.col(f"gl{k}") / total, F.lit(1e-10)))), 6).alias(f"l{k}") for k in range(3)])
    best = F.when((F.col("l0") >= F.col("l1")) & (F.col("l0") >= F.col("l2")), "HOM_A").when(F.col("l1") >= F.col("l2"), "HET").otherwise("HOM_B")
    return sums.select("chrom", "start", "sample_idx", best.alias("group"))
