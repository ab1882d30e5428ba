"""Windows over positions: grids, site counts, and joins of intervals by bins.

Positions meet windows without range predicates: a fixed grid is arithmetic, and intervals meet over the bins that they
cover, so that every plan is an equi-join or an explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


BUCKETS = 200


def bucketed(distinct: DataFrame, value: str) -> DataFrame:
    """Rows of distinct numbers with `_p`: one of at most BUCKETS ranges of about as many rows each. The bounds are approximate percentiles,
    so a row's bucket depends on its value alone, however often and wherever the plan is evaluated."""
    at = [i / BUCKETS for i in range(1, BUCKETS)]
    found = distinct.agg(F.percentile_approx(value, at, 10_000).alias("b")).first()
    bounds = F.array(*[F.lit(x) for x in sorted(set(found["b"] or []))]).cast(f"array<{dict(distinct.dtypes)[value]}>")
    return distinct.withColumn("_p", F.size(F.filter(bounds, lambda b: b < F.col(value))))


def running(parts: DataFrame, order: str, count: str, part: str = "_p") -> DataFrame:
    """parts with `_run`: the running sum of count in order, own row included. Parts hold ranges in order; sums of whole parts (a few
    rows) are carried forward."""
    sums = parts.groupBy(part).agg(F.sum(count).alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.sum(count).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_run", own).join(F.broadcast(sums), part).withColumn("_run", F.col("_run") + F.col("_b")).drop("_b")


def numbered(sites: DataFrame, order: list[str], by: str = "chrom", block: int = 1_000_000) -> DataFrame:
    """sites with `_i`, their place in order within `by` from 0, and `_n`, how many there are. order starts with a position; sites are
    numbered within blocks of positions, and counts of blocks (as many rows as the genome has blocks) are carried forward, so that
    no task sorts a chromosome."""
    at = sites.withColumn("_blk", F.floor(F.col(order[0]) / block))
    sizes = at.groupBy(by, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by)
    first = sizes.select(F.col(by).alias("_by"), F.col("_blk").alias("_bk"), F.coalesce(F.sum("_c").over(w.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"), F.sum("_c").over(w).alias("_n"))
    own = F.row_number().over(Window.partitionBy(by, "_blk").orderBy(*order)) - 1
    return at.withColumn("_o", own).join(first, (F.col(by) == F.col("_by")) & (F.col("_blk") == F.col("_bk"))).withColumn("_i", F.col("_o") + F.col("_f")).drop("_blk", "_o", "_by", "_bk", "_f")


def fixed_grid(points: DataFrame, width: int, step: int, origin: int = 0, pos: str = "pos") -> DataFrame:
    """points once for each window [start, start + width - 1] that holds them; windows start at origin + k * step, k >= 0."""
    p = F.col(pos) - origin
    first = F.greatest(F.lit(0), F.ceil((p - (width - 1)) / step)).cast("long")
    return points.filter(p >= 0).withColumn("_w", F.explode(F.sequence(first, F.floor(p / step).cast("long")))).withColumn("start", F.col("_w") * step + origin).withColumn("end", F.col("start") + width - 1).drop("_w")


def site_windows(sites: DataFrame, width: int, step: int, order: list[str], by: str = "chrom") -> DataFrame:
    """sites once for each window of `width` consecutive sites that holds them; partial windows at the end are left out.
    Adds window_id, from 1 for each `by`. A chromosome with fewer sites than a window has one window of all."""
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - width) / step))
    lo = F.greatest(F.lit(0), F.ceil((F.col("_i") - (width - 1)) / step))
    hi = F.least(last, F.floor(F.col("_i") / step))
    return numbered(sites, order, by).filter(lo <= hi).withColumn("window_id", F.explode(F.sequence((lo + 1).cast("long"), (hi + 1).cast("long")))).drop("_i", "_n")


def bins(start: Column, end: Column, size: int) -> Column:
    """All bins that [start, end] covers; none where end < start."""
    return F.when(end >= start, F.sequence(F.floor(start / size).cast("long"), F.floor(end / size).cast("long"))).otherwise(F.array().cast("array<long>"))


def overlap_join(left: DataFrame, right: DataFrame, size: int, strict: bool = False, how: str = "inner", suffix: str = "_r") -> DataFrame:
    """Pairs of intervals (chrom, start, end) that overlap: closed, or strict (touching ends do not count). Each pair once: it
    belongs to the first bin that both cover. Columns of right other than chrom get the suffix."""
    a = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), size)))
    b = right.select(F.col("chrom").alias("_c"), *[F.col(c).alias(c + suffix) for c in right.columns if c != "chrom"]).withColumn("_b", F.explode(bins(F.col("start" + suffix), F.col("end" + suffix), size)))
    s, e = F.col("start" + suffix), F.col("end" + suffix)
    touch = (F.col("start") < e) & (F.col("end") > s) if strict else (F.col("start") <= e) & (F.col("end") >= s)
    first = F.col("_bin") == F.floor(F.greatest(F.col("start"), s) / size)
    on = (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & touch
    if how in ("left_semi", "left_anti"):
        if how == "left_semi":
            return a.join(b, on, how).drop("_bin").distinct()
        hit = a.join(b, on, "left_semi").select(*left.columns).distinct()
        return left.join(hit, left.columns, "left_anti")
    pairs = a.join(b, on & first).drop("_bin", "_b", "_c")
    if how == "inner":
        return pairs
    missing = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True)


def points_in(points: DataFrame, windows: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """points with every window (chrom, start, end) that holds them, ends included."""
    w = windows.withColumn("_b", F.explode(bins(F.col("start"), F.col("end"), size))).withColumnRenamed("chrom", "_c")
    return points.withColumn("_p", F.floor(F.col(pos) / size)).join(w, (F.col("chrom") == F.col("_c")) & (F.col("_p") == F.col("_b")) & F.col(pos).between(F.col("start"), F.col("end"))).drop("_p", "_b", "_c")


def _beside(marks: DataFrame, genes: DataFrame, key: list[str], edge: str, back: bool, block: int) -> DataFrame:
    """For every mark (chrom, at, key...) the gene whose `edge` is the last at or before it (back), or the first at or after it: key...,
    at, ord, gene. The last seen in a block of positions is carried over one row a block."""
    none = F.lit(None)
    names = [f"k_{c}" for c in key]
    found = F.when(F.col("kind") != 1, F.struct("at", "ord", "gene"))
    ends = genes.select("chrom", F.col(edge).alias("at"), F.lit(0 if back else 2).alias("kind"), *[none.cast(t).alias(n) for n, t in zip(names, [dict(marks.dtypes)[c] for c in key], strict=True)], F.col("ord").cast("long").alias("ord"), F.col("gene_id").alias("gene"))
    rows = marks.select("chrom", "at", F.lit(1).alias("kind"), *[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], none.cast("long").alias("ord"), none.cast("string").alias("gene")).unionByName(ends).withColumn("_blk", F.floor(F.col("at") / block))
    # ties in distance go to the least ord: of equal ends it is the last row before the mark, of equal starts the first after it
    order = Window.partitionBy("chrom", "_blk").orderBy("at", "kind", F.desc("ord") if back else F.asc("ord"))
    seen = F.last(found, True).over(order) if back else F.first(found, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    across = Window.partitionBy("chrom").orderBy("_blk")
    best = F.max_by("x", F.struct(F.col("at"), -F.col("ord"))) if back else F.min("x")
    sums = rows.withColumn("x", found).filter("kind <> 1").groupBy("chrom", "_blk").agg(best.alias("x"))
    blocks = rows.select("chrom", "_blk").distinct().join(sums, ["chrom", "_blk"], "left")
    carried = F.last("x", True).over(across.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("x", True).over(across.rowsBetween(1, Window.unboundedFollowing))
    got = rows.withColumn("_own", seen).filter("kind = 1").join(blocks.select("chrom", "_blk", carried.alias("_far")), ["chrom", "_blk"])
    return got.select(*[F.col(n).alias(c) for c, n in zip(key, names, strict=True)], F.coalesce("_own", "_far").alias("found"))


def nearest(regions: DataFrame, genes: DataFrame, key: list[str], block: int = 1_000_000) -> DataFrame:
    """regions with the gene nearest to their midpoint: distance 0 inside a gene, the first gene (ord) on ties, null where the
    chromosome has none. Neighbours on both sides are found in blocks of positions with carried seams; genes that hold the midpoint come
    from an overlap join."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    r = regions.withColumn("_mid", mid)
    inside = points_in(r.select("chrom", *[c for c in key if c != "chrom"], "_mid").withColumnRenamed("_mid", "pos"), genes, 50_000).groupBy("chrom", *[c for c in key if c != "chrom"]).agg(F.min_by("gene_id", "ord").alias("_in"))
    marks = r.select(F.col("chrom"), F.col("_mid").alias("at"), *[c for c in key if c != "chrom"])
    before = _beside(marks, genes, key, "end", True, block).withColumnRenamed("found", "_p")
    after = _beside(marks, genes, key, "start", False, block).withColumnRenamed("found", "_q")
    j = r.join(before, key, "left").join(after, key, "left").join(inside, key, "left")
    dp, dq = F.col("_mid") - F.col("_p.at"), F.col("_q.at") - F.col("_mid")
    left = F.struct(dp.alias("d"), F.col("_p.ord").alias("o"), F.col("_p.gene").alias("g"))
    right = F.struct(dq.alias("d"), F.col("_q.ord").alias("o"), F.col("_q.gene").alias("g"))
    pick = F.when(F.col("_p").isNull() & F.col("_q").isNull(), None).when(F.col("_p").isNull(), right).when(F.col("_q").isNull(), left).otherwise(F.least(left, right))
    return j.withColumn("_n", pick).select(*regions.columns, F.coalesce("_in", F.col("_n.g")).alias("nearest_gene"), F.when(F.col("_in").isNotNull(), 0).otherwise(F.col("_n.d")).cast("long").alias("gene_distance"))


def grid(spans: DataFrame, width: int, step: int) -> DataFrame:
    """Windows of a fixed grid over each (chrom, start, end): the first starts where the span does."""
    return spans.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(step).cast("long"))).alias("start")).withColumn("end", F.col("start") + width - 1)
