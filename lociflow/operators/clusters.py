"""Average-linkage clustering of samples by rounds of mutual nearest neighbours.

A link is a pair of samples that share something, so that pairs sharing nothing need no row. Clusters are named by their least sample and
keep sums of links, which add up when clusters merge; a mean is a sum over the product of two sizes. In every round each cluster finds its
nearest (ties: the pair with the least names), and all pairs that choose each other merge at once. Average linkage never brings a
merged pair nearer to a third cluster than its parts were, so the merges are those of merging one nearest pair after another. Clusters
without links to each other come last, all at the same height, in the order of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.sources import scratch


def _cut(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(members: DataFrame, merges: DataFrame, by: list[str]) -> DataFrame:
    """Members after a round: those of both parts are in the cluster lo, and those of the part that stands second move behind the first."""
    parts = merges.select(*by, "lo", F.explode(F.array(F.struct(F.col("lo").alias("c"), F.when(F.col("lo_first"), 0).otherwise(F.col("n_hi")).alias("by_")), F.struct(F.col("hi").alias("c"), F.when(F.col("lo_first"), F.col("n_lo")).otherwise(0).alias("by_")))).alias("x")).select(*by, F.col("x.c").alias("c"), F.col("lo").alias("to"), F.col("x.by_").alias("by_"))
    met = members.join(parts, [*by, "c"], "left")
    return met.select(*by, "sample_idx", F.coalesce("to", "c").alias("c"), (F.col("place") + F.coalesce("by_", F.lit(0))).cast("long").alias("place"))


def average_linkage(links: DataFrame, samples: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """T09. links: by..., i, j, shared (a symmetric matrix with its diagonal, zeros left out); samples: by..., sample_idx. Distance is the
    greatest value + 1 - shared.

    Returns merges (by..., lo, hi, height, size; lo and hi are the least samples of the parts) and the order of leaves (by..., sample_idx,
    place from 0): of two parts the one merged at less height stands first, single samples before all, ties by least sample."""
    top = _cut(links.groupBy(*by).agg(F.max("shared").cast("double").alias("top")), "top")
    pairs = _cut(links.filter("i <> j and shared > 0").select(*by, "i", "j", F.col("shared").cast("long").alias("s")), "pairs")
    clusters = _cut(samples.select(*by, F.col("sample_idx").alias("c"), F.lit(1).cast("long").alias("n"), F.lit(-1.0).alias("h")).distinct(), "clusters")
    members = clusters.select(*by, F.col("c").alias("sample_idx"), "c", F.lit(0).cast("long").alias("place"))
    done = None
    while not pairs.isEmpty():
        of = lambda c: clusters.select(*by, F.col("c").alias(c), F.col("n").alias(f"n_{c}"), F.col("h").alias(f"h_{c}"))
        mean = F.col("s") / (F.col("n_i") * F.col("n_j"))
        nearest = pairs.join(of("i"), [*by, "i"]).join(of("j"), [*by, "j"]).groupBy(*by, "i").agg(F.min(F.struct((-mean).alias("m"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))).alias("x"))
        mutual = nearest.groupBy(*by, "x.lo", "x.hi").agg(F.count(F.lit(1)).alias("k"), F.min("x.m").alias("m")).filter("k = 2")
        found = mutual.join(of("lo"), [*by, "lo"]).join(of("hi"), [*by, "hi"]).join(top, by)
        merges = _cut(found.select(*by, "lo", "hi", (F.col("top") + 1 + F.col("m")).alias("height"), (F.col("n_lo") + F.col("n_hi")).alias("size"), "n_lo", "n_hi", (F.struct("h_lo", "lo") < F.struct("h_hi", "hi")).alias("lo_first")), "merges")
        to = lambda c: merges.select(*by, F.col("hi").alias(c), F.col("lo").alias(f"to_{c}"))
        moved = pairs.join(to("i"), [*by, "i"], "left").join(to("j"), [*by, "j"], "left").select(*by, F.coalesce("to_i", "i").alias("i"), F.coalesce("to_j", "j").alias("j"), "s")
        pairs = _cut(moved.filter("i <> j").groupBy(*by, "i", "j").agg(F.sum("s").alias("s")), "pairs")
        changed = merges.select(*by, F.col("lo").alias("c"), F.col("size").alias("n_"), F.col("height").alias("h_"))
        rest = clusters.join(merges.select(*by, F.col("hi").alias("c")), [*by, "c"], "left_anti").join(changed, [*by, "c"], "left")
        clusters, members = _cut(rest.select(*by, "c", F.coalesce("n_", "n").alias("n"), F.coalesce("h_", "h").alias("h")), "clusters"), _cut(_placed(members, merges, by), "members")
        done = merges if done is None else done.unionByName(merges)
    # what shares nothing: the first two by height, then each cluster before all that came together so far
    w = Window.partitionBy(*by).orderBy("c")
    chain = clusters.withColumn("r", F.row_number().over(w)).withColumn("first", F.first("c").over(w)).withColumn("n_first", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("later", F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    second = chain.filter("r = 2").select(*by, F.col("h").alias("h2"), F.col("n").alias("n2"))
    head = chain.join(second, by, "left").withColumn("swap", F.max(F.when((F.col("r") == 1) & (F.col("h") > F.col("h2")), True)).over(Window.partitionBy(*by)))
    front = F.when(F.col("r") == 1, F.col("later") - F.when(F.col("swap").isNull(), F.coalesce("n2", F.lit(0))).otherwise(0)).when((F.col("r") == 2) & F.col("swap").isNull(), F.col("later") + F.col("n_first")).otherwise(F.col("later"))
    order = members.join(head.select(*by, "c", front.alias("front")), [*by, "c"]).select(*by, "sample_idx", (F.col("place") + F.col("front")).alias("place"))
    last = chain.filter("r > 1").join(top, by, "left").select(*by, F.col("first").alias("lo"), F.col("c").alias("hi"), (F.coalesce("top", F.lit(0.0)) + 1).alias("height"), (F.col("n_first") + F.col("n")).alias("size"))
    merged = last if done is None else done.select(*last.columns).unionByName(last)
    return merged, order


def class_order(rows: DataFrame, sample: str, cls: str, value: str) -> DataFrame:
    """Samples by class and then by the mean of a value (ties by sample): sample, class, mean, place from 0. Samples are the rows that
    a picture shows, so their number bounds the window."""
    mean = rows.groupBy(sample, cls).agg(F.avg(value).alias("mean"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(cls, "mean", sample)) - 1)
