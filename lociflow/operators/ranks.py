"""Rank tests of many groups from one table of ranks, and their permutations from a histogram.

Values are counted, dealt into buckets of neighbouring values, and counted on through the buckets' totals: a value's place needs no sort of
all rows. A group's U against everything else follows from the places of its own values, its complement's sums by subtraction, and
the median of "all but the group" from the place that its own values leave free. Permuted rank sums are drawn from the histogram of tied
values: first how many of the group fall into each bucket, then into each value of a bucket; rows are never shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.functions import expr
from lociflow.operators.windows import BUCKETS
from lociflow.sources import scratch

#: numpy draws hypergeometric numbers from populations below this; larger ones are drawn from the normal of the same mean and variance.
MOST_DRAWN = 10**9


def cut(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_on(parts: DataFrame, by: list[str], order: str, count: str) -> DataFrame:
    """parts (by..., _p, order, count) with `run`, the running sum of count within by; buckets _p hold ranges of order."""
    w = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*by, "_p").agg(F.sum(count).alias("_s")).select(*by, "_p", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_b"))
    own = F.sum(count).over(Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(before, [*by, "_p"]).withColumn("run", F.col("_own") + F.col("_b")).drop("_own", "_b")


def value_table(hist: DataFrame, by: list[str]) -> DataFrame:
    """hist (by..., v, t) with _p and run, as a table: BUCKETS ranges of about as many values for each key of by."""
    at = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = cut(hist.groupBy(*by).agg(F.array_distinct(F.percentile_approx("v", at, 10_000)).alias("_bounds")), "bounds")
    parts = hist.join(bounds, by).withColumn("_p", F.size(F.filter("_bounds", lambda b: b < F.col("v")))).drop("_bounds")
    return cut(counted_on(cut(parts, "buckets"), by, "v", "t"), "ranks")


def value_at(values: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked (by..., q) with the value at 0-based place q of values (by..., v, t, _p, run); each place is looked up once."""
    ends = values.groupBy(*by, "_p").agg(F.max("run").alias("to")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("to", "_p"))).alias("_e"))
    marks = asked.select(*by, "q").distinct().join(ends, by).withColumn("_p", F.element_at(F.filter("_e", lambda x: x["to"] > F.col("q")), 1)["_p"])
    both = values.filter("t > 0").select(*by, "_p", (F.col("run") - F.col("t")).alias("at"), F.lit(0).alias("kind"), "v").unionByName(marks.select(*by, "_p", F.col("q").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v")))
    found = both.withColumn("x", F.last("v", True).over(Window.partitionBy(*by, "_p").orderBy("at", "kind"))).filter("kind = 1")
    return asked.join(found.select(*by, F.col("at").alias("q"), F.col("x").alias("value")), [*by, "q"], "left")


def _draw(rng: np.random.Generator, good: int, rest: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hypergeometric numbers: of n drawn from good + rest, how many are of the good."""
    if good + int(rest.max(initial=0)) < MOST_DRAWN:
        return rng.hypergeometric(good, rest, n)
    total = (good + rest).astype(float)
    share = good / np.maximum(total, 1)
    sd = np.sqrt(np.maximum(n * share * (1 - share) * (total - n) / np.maximum(total - 1, 1), 0))
    return np.clip(np.rint(rng.normal(n * share, sd)), np.maximum(0, n - rest), np.minimum(good, n)).astype(np.int64)


def _dealt(counts: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """For every replicate, how many of its n fall on each count in turn."""
    left, rest = n.copy(), np.full(len(n), int(counts.sum()), np.int64)
    for c in counts.tolist():
        rest = rest - c
        got = _draw(rng, c, rest, left) if c else np.zeros_like(left)
        left = left - got
        yield got


def _seeded(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng([seed, *[zlib.crc32(str(x).encode()) for x in names]])


def _by_bucket(batches: Iterator[pa.RecordBatch], seed: int, replicates: int) -> Iterator[pa.RecordBatch]:
    """key, n, _p, m: how many of n fall into each bucket, a list over replicates."""
    for batch in batches:
        out: list[tuple] = []
        for key, n, parts in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            rng = _seeded(seed, key, n)
            counts = np.array([x["t"] for x in parts], np.int64)
            out += [(key, n, x["_p"], m) for x, m in zip(parts, _dealt(counts, np.full(replicates, n, np.int64), rng), strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["key", "n", "_p", "m"])


def _by_value(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """key, n, sums: the part of the rank sums that a bucket gives, a list over replicates."""
    for batch in batches:
        out: list[tuple] = []
        for key, n, p, m, values in zip(*[batch.column(c).to_pylist() for c in ("key", "n", "_p", "m", "values")], strict=True):
            rng, sums = _seeded(seed, key, n, p), np.zeros(len(m))
            counts, ranks = np.array([x["t"] for x in values], np.int64), [x["rank"] for x in values]
            for r, got in zip(ranks, _dealt(counts, np.array(m, np.int64), rng), strict=True):
                sums += r * got
            out.append((key, n, sums))
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.list_(pa.float64())))], ["key", "n", "sums"])


def permuted(values: DataFrame, sizes: DataFrame, by: list[str], replicates: int, seed: int = 1) -> DataFrame:
    """By..., n, devs: for each size n of a group among values (by..., v, t, _p, run; all t rows of a key together), the sorted distances
    |U - mean| of `replicates` random groups. A task holds one bucket's distinct values and one number for each replicate."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by]).alias("key")
    parts = values.filter("t > 0").groupBy(*by, "_p").agg(F.sum("t").alias("t"), F.sort_array(F.collect_list(F.struct("run", "t"))).alias("x"))
    ranked = parts.select(key, "_p", F.transform("x", lambda x: F.struct(x["t"].alias("t"), (x["run"] - (x["t"] - 1) / 2.0).alias("rank"))).alias("values"))
    whole = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_p", "t"))).alias("parts"), F.sum("t").alias("total"))
    tests = sizes.select(*by, F.col("n").cast("long").alias("n")).distinct()
    first = tests.join(whole, by).select(key, "n", "parts").mapInArrow(lambda b: _by_bucket(b, seed, replicates), "key string, n long, _p int, m array<long>")
    second = first.join(ranked, ["key", "_p"]).select("key", "n", "_p", "m", "values").mapInArrow(lambda b: _by_value(b, seed), "key string, n long, sums array<double>")
    each = second.select("key", "n", F.posexplode("sums").alias("rep", "s")).groupBy("key", "n", "rep").agg(F.sum("s").alias("s"))
    named = tests.join(whole.select(*by, "total"), by).select(*by, key, "n", "total")
    n = F.col("n").cast("double")
    dev = F.abs(F.col("s") - n * (n + 1) / 2 - n * (F.col("total") - n) / 2)
    return each.join(named, ["key", "n"]).groupBy(*by, "n").agg(F.sort_array(F.collect_list(F.round(dev, 6))).alias("devs"))


def permutation_p(devs: Column, seen: Column) -> Column:
    return (F.size(F.filter(devs, lambda x: x >= F.round(seen, 6))) + 1) / (F.size(devs) + 1.0)


def region_tests(long: DataFrame, rest: str | None = None, permutations: int = 0, seed: int = 1) -> DataFrame:
    """Long (region, stat_name, v): every region's values against all others, or against those of the region `rest`: target,
    stat_name, sizes, means, medians, effect, U, z, p, direction and permutation p. Rows are counted once, however many regions there are;
    a region with any share of the rows is spread over buckets of values."""
    by, own = ["stat_name"], ["stat_name", "region"]
    counts = cut(long.groupBy("stat_name", "region", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    among = F.col("c") if rest is None else F.when(F.col("region") == rest, F.col("c")).otherwise(0)
    values = value_table(counts.groupBy("stat_name", "v").agg(F.sum(among).alias("t")), by)
    tested = counts if rest is None else counts.filter(F.col("region") != rest)
    met = cut(counted_on(tested.join(values, ["stat_name", "v"]).withColumnRenamed("run", "all"), own, "v", "c"), "met")
    total = values.groupBy(*by).agg(F.sum("t").alias("n_all"), F.sum(F.col("t") * F.col("v")).alias("s_all"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("tie_all"))
    c, t = F.col("c"), F.col("t")
    cube = lambda x: x.cast("double") * x * x - x
    sums = met.groupBy(*own).agg(F.sum("c").alias("n1"), F.sum(c * F.col("v")).alias("s1"), F.sum(c * (F.col("all") - t + t / 2.0)).alias("u"), F.sum(cube(c + t) - cube(t)).alias("more"))
    g = sums.join(F.broadcast(total), by)
    n1 = F.col("n1").cast("double")
    if rest is None:
        g = g.select(*own, n1.alias("n1"), (F.col("n_all") - n1).alias("n2"), "s1", (F.col("s_all") - F.col("s1")).alias("s2"), (F.col("u") - n1 * n1 / 2).alias("u"), F.col("tie_all").alias("tie"))
    else:
        g = g.select(*own, n1.alias("n1"), F.col("n_all").cast("double").alias("n2"), "s1", F.col("s_all").alias("s2"), "u", (F.col("tie_all") + F.col("more")).alias("tie"))
    g = cut(g, "sums")
    low, high = (lambda n: F.floor((n - 1) / 2)), (lambda n: F.floor(n / 2))
    j = met.join(g.select(*own, "n1", "n2"), own)
    ask = [F.min(F.when(F.col("run") > f(F.col("n1")), F.col("v"))).alias(x) for f, x in ((low, "m1a"), (high, "m1b"))]
    free = F.col("all") - F.col("run")
    if rest is None:
        for f, x in ((low, "a"), (high, "b")):
            k = f(F.col("n2"))
            ask += [F.coalesce(F.max(F.when(free <= k, F.col("run"))), F.lit(0)).alias(f"skip_{x}"), F.min(F.when(free > k, F.col("v"))).alias(f"next_{x}")]
    med = cut(j.groupBy(*own).agg(*ask).join(g, own), "medians")
    if rest is None:
        for f, x in ((low, "a"), (high, "b")):
            got = value_at(values, med.filter("n2 > 0").select("region", "stat_name", (f(F.col("n2")) + F.col(f"skip_{x}")).cast("long").alias("q")), by)
            med = med.join(got.select(*own, F.col("value").alias(f"at_{x}")), own, "left").withColumn(f"m2{x}", F.when(F.col("n2") > 0, F.least(f"at_{x}", f"next_{x}")))
    else:
        middle = F.col("n_all").cast("double")
        of = values.join(F.broadcast(total), by).groupBy(*by).agg(*[F.min(F.when((F.col("run") > f(middle)) & (t > 0), F.col("v"))).alias(f"m2{x}") for f, x in ((low, "a"), (high, "b"))])
        med = med.join(F.broadcast(of), by)
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    enough = (n1 >= 2) & (n2 >= 2)
    var = n1 * n2 / 12 * (n + 1 - F.col("tie") / (n * (n - 1)))
    z = F.when(enough & (var > 0), (F.col("u") - n1 * n2 / 2) / F.sqrt(var))
    mean1, mean2 = F.col("s1") / n1, F.when(n2 > 0, F.col("s2") / n2)
    diff = mean1 - mean2
    way = F.when(~enough, "NA").when(diff > 0, "inside_higher").when(diff < 0, "inside_lower").otherwise("same")
    out = med.select(F.col("region").alias("target"), "stat_name", n1.cast("long").alias("n_inside"), n2.cast("long").alias("n_outside"), mean1.alias("mean_inside"), mean2.alias("mean_outside"), ((F.col("m1a") + F.col("m1b")) / 2).alias("median_inside"), ((F.col("m2a") + F.col("m2b")) / 2).alias("median_outside"), diff.alias("effect"), F.when(enough, F.col("u")).alias("U"), z.alias("z"), expr.normal_p(z).alias("p"), way.alias("direction"))
    if not permutations:
        return out
    sizes = out.filter("U is not null").select("stat_name", "target", F.col("n_inside").alias("n"))
    if rest is None:
        devs = permuted(values, sizes, by, permutations, seed)
        met_devs = out.join(devs.withColumnRenamed("n", "n_inside"), ["stat_name", "n_inside"], "left")
    else:  # each region with the rest is a histogram of its own
        ref = values.filter("t > 0").select("stat_name", "v", F.col("t").alias("t"))
        mine = met.select("stat_name", F.col("region").alias("target"), "v", F.col("c").alias("t"))
        both = mine.unionByName(mine.select("stat_name", "target").distinct().join(ref, "stat_name")).groupBy("stat_name", "target", "v").agg(F.sum("t").alias("t"))
        devs = permuted(value_table(both, ["stat_name", "target"]), sizes, ["stat_name", "target"], permutations, seed)
        met_devs = out.join(devs.drop("n"), ["stat_name", "target"], "left")
    seen = F.abs(F.col("U") - F.col("n_inside") * F.col("n_outside") / 2)
    return met_devs.withColumn("permutation_p", F.when(F.col("devs").isNotNull(), permutation_p(F.col("devs"), seen))).drop("devs")


def group_permutation_p(rows: DataFrame, by: list[str], replicates: int, seed: int = 1) -> DataFrame:
    """T03 for rows (by..., v, inside): by..., permutation_p of |U - mean|, for groups with two values on each side."""
    hist = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("inside").cast("long")).alias("c"))
    values = value_table(hist, by)
    rank = F.col("run") - (F.col("t") - 1) / 2.0
    g = values.groupBy(*by).agg(F.sum("c").cast("double").alias("n"), F.sum("t").cast("double").alias("total"), F.sum(F.col("c") * rank).alias("R")).filter("n >= 2 and total - n >= 2")
    n = F.col("n")
    seen = F.abs(F.col("R") - n * (n + 1) / 2 - n * (F.col("total") - n) / 2)
    return g.select(*by, "n", seen.alias("seen")).join(permuted(values, g, by, replicates, seed), [*by, "n"]).select(*by, permutation_p(F.col("devs"), F.col("seen")).alias("permutation_p"))

