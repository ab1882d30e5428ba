"""Heterozygosity windows from HWE sites, robust thresholds, and overlays of candidate intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators.ranks import cut
from lociflow.operators.scan import whole_median
from lociflow.operators.windows import fixed_grid, overlap_join

#: Fixed scales: name, width, step.
SCALES = (("5kb", 5_000, 1_000), ("10kb", 10_000, 2_000), ("50kb", 50_000, 10_000), ("100kb", 100_000, 20_000), ("250kb", 250_000, 50_000), ("500kb", 500_000, 100_000), ("1Mb", 1_000_000, 200_000))


def heterozygosity(sites: DataFrame) -> DataFrame:
    """Sites (chrom, pos, freq, f) with hexp and hobs = hexp * (1 - f), clamped to [0, 1]."""
    hexp = 2 * F.col("freq") * (1 - F.col("freq"))
    return sites.withColumn("hexp", hexp).withColumn("hobs", F.least(F.lit(1.0), F.greatest(F.lit(0.0), hexp * (1 - F.col("f")))))


def robust_limits(sites: DataFrame, mad_n: float = 3.0) -> DataFrame:
    """A10: one row: low and high limits of hobs and f, median +- mad_n * 1.4826 * MAD over all sites."""
    k, limits = mad_n * 1.4826, []
    for c in ("hobs", "f"):
        m = whole_median(sites, c)
        far = whole_median(sites.select(F.abs(F.col(c) - F.lit(m)).alias("d")), "d")
        limits += [None if m is None else m - k * far, None if m is None else m + k * far]
    return sites.sparkSession.createDataFrame([tuple(limits)], "h_low double, h_high double, f_low double, f_high double")


#: Ranges of values in which sites are counted before a window's median is looked for in one or two of them.
RANGES = 64
_FLAGS = {"hl": "low_hobs", "hh": "high_hobs", "fl": "low_f", "fh": "high_f"}


def _cells(df: DataFrame, scales: tuple, unit: int) -> DataFrame:
    """df (cell of `unit`) once for each scale, with the cell `c` of the scale's own step."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("scale"), F.lit(step // unit).alias("per")) for name, _, step in scales]))
    return df.withColumn("_x", each).select("*", F.col("_x.scale").alias("scale"), F.floor(F.col("cell") / F.col("_x.per")).cast("long").alias("c")).drop("_x", "cell")


def _over(df: DataFrame, scales: tuple, back: bool = False) -> DataFrame:
    """Cells once for each window w of their scale that holds them; with back, windows once for each of their cells."""
    span = F.coalesce(*[F.when(F.col("scale") == name, F.lit(width // step - 1)) for name, width, step in scales])
    if back:
        return df.withColumn("c", F.explode(F.sequence(F.col("w"), F.col("w") + span)))
    return df.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("c") - span), F.col("c"))))


def _medians(sites: DataFrame, scales: tuple, unit: int) -> DataFrame:
    """scale, chrom, w, median_hobs, median_f. Sites are counted by range of values in the smallest cells; counts add up to windows; a
    window's middle places lie in one or two ranges, and only sites of these meet it."""
    at = [i / RANGES for i in range(1, RANGES)]
    bounds = sites.agg(*[F.array_distinct(F.percentile_approx(m, at, 10_000)).alias(m) for m in ("hobs", "f")]).first()  # 2 x RANGES numbers

    def ranged(m: str) -> Column:
        known = F.array(*[F.lit(x) for x in bounds[m] or []]).cast("array<double>")
        return F.struct(F.lit(m).alias("m"), F.size(F.filter(known, lambda b: b < F.col(m))).alias("r"), F.col(m).alias("v"))

    long = sites.select("chrom", "cell", F.explode(F.array(ranged("hobs"), ranged("f"))).alias("x")).select("chrom", "cell", "x.*").filter("v is not null")
    long = cut(long.groupBy("chrom", "cell", "m", "r", "v").agg(F.count(F.lit(1)).alias("k")), "ranges")  # ranges are looked up once
    key = ["scale", "chrom", "w", "m"]
    cells = long.groupBy("chrom", "cell", "m", "r").agg(F.sum("k").alias("n"))
    counts = _over(_cells(cells, scales, unit).groupBy("scale", "chrom", "c", "m", "r").agg(F.sum("n").alias("n")), scales).groupBy(*key, "r").agg(F.sum("n").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("r"))).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    before = F.col("upto") - F.col("n")
    need = run.filter((F.col("upto") > low) & (before <= high)).select(*key, "r", F.when(before <= low, low - before).alias("a"), F.when(F.col("upto") > high, high - before).alias("b"))
    need = cut(need, "need")
    asked = _over(need, scales, back=True)
    values = _cells(long, scales, unit).join(asked.select("scale", "chrom", "c", "m", "r").distinct(), ["scale", "chrom", "c", "m", "r"], "left_semi").groupBy("scale", "chrom", "c", "m", "r", "v").agg(F.sum("k").alias("k"))
    met = asked.join(values, ["scale", "chrom", "c", "m", "r"]).groupBy(*key, "r", "a", "b", "v").agg(F.sum("k").alias("k"))
    own = met.withColumn("upto", F.sum("k").over(Window.partitionBy(*key, "r").orderBy("v")))
    found = own.groupBy(*key).agg(F.min(F.when(F.col("upto") > F.col("a"), F.col("v"))).alias("x"), F.min(F.when(F.col("upto") > F.col("b"), F.col("v"))).alias("y"))
    return found.groupBy("scale", "chrom", "w").agg(*[F.max(F.when(F.col("m") == m, (F.col("x") + F.col("y")) / 2)).alias(f"median_{m}") for m in ("hobs", "f")])


def windows(sites: DataFrame, scales: tuple = SCALES, mad_n: float = 3.0) -> DataFrame:
    """A09 for all scales: counts, mean, median, population sd, min and max of hobs and f, and outlier counts and shares.
    Windows start at 1; the last of a chromosome ends at its last site; empty windows are left out. A width is a multiple of its step.

    Everything is summed in cells of the greatest common step first; cells, not sites, meet the windows that hold them."""
    unit = math.gcd(*[step for _, _, step in scales])
    if any(width % step for _, width, step in scales):
        raise ValueError("widths must be multiples of their steps")
    lim = robust_limits(sites, mad_n)
    last = sites.groupBy("chrom").agg(F.max("pos").alias("_last"))
    own = sites.filter(F.col("pos") >= 1).select("chrom", F.floor((F.col("pos") - 1) / unit).cast("long").alias("cell"), "hobs", "f")
    flags = {"hl": F.col("hobs") < F.col("h_low"), "hh": F.col("hobs") > F.col("h_high"), "fl": F.col("f") < F.col("f_low"), "fh": F.col("f") > F.col("f_high")}
    sums = [F.sum(x).alias(f"{k}_{c}") for c in ("hobs", "f") for k, x in (("s", F.col(c)), ("q", F.col(c) * F.col(c)))] + [g(c).alias(f"{k}_{c}") for c in ("hobs", "f") for k, g in (("min", F.min), ("max", F.max), ("n", F.count))]
    cells = own.crossJoin(F.broadcast(lim)).groupBy("chrom", "cell").agg(F.count(F.lit(1)).alias("n_sites"), *sums, *[F.sum(x.cast("int")).alias(c) for c, x in flags.items()])
    added = [c for c in cells.columns if c not in ("chrom", "cell")]
    merge = [(F.min if c.startswith("min_") else F.max if c.startswith("max_") else F.sum)(c).alias(c) for c in added]
    w = _over(_cells(cells, scales, unit).groupBy("scale", "chrom", "c").agg(*merge), scales).groupBy("scale", "chrom", "w").agg(*merge).join(_medians(own, scales, unit), ["scale", "chrom", "w"], "left")
    mean = lambda c: F.col(f"s_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))
    stats = [x.alias(f"{k}_{c}") for c in ("hobs", "f") for k, x in (("mean", mean(c)), ("median", F.col(f"median_{c}")), ("sd", F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0)) - mean(c) * mean(c)))), ("min", F.col(f"min_{c}")), ("max", F.col(f"max_{c}")))]
    width, step = [F.coalesce(*[F.when(F.col("scale") == s[0], F.lit(s[i])) for s in scales]) for i in (1, 2)]
    start = F.col("w") * step + 1
    out = w.join(F.broadcast(last), "chrom")
    return out.select("chrom", "scale", start.alias("start"), F.least(start + width - 1, "_last").alias("end"), "n_sites", *stats, *[F.col(c).alias(f"n_{x}_outlier") for c, x in _FLAGS.items()], *[(F.col(c) / F.col("n_sites")).alias(f"frac_{x}_outlier") for c, x in _FLAGS.items()])


def group_hobs(dos: DataFrame, groups: DataFrame, width: int, step: int) -> DataFrame:
    """Mean observed heterozygosity and number of sites (not samples) by window and group."""
    sites = dos.join(groups, "sample_idx").groupBy("chrom", "pos", "group").agg(F.avg("het").alias("h"))
    return fixed_grid(sites, width, step, 1).groupBy("chrom", "start", "end", "group").agg(F.avg("h").alias("hobs"), F.count(F.lit(1)).alias("n_sites"))


def distortion(mean_in: Column, median_in: Column, mean_beside: Column, high_f: Column, low_hobs: Column) -> Column:
    """P25: the pattern of a candidate from F inside (mean, median) and beside (mean), and the shares of outlying sites inside."""
    gap = mean_in - mean_beside
    lifted = (gap > 0.05) & (high_f > 0.2)
    return (F.when(mean_in.isNull() | mean_beside.isNull(), "insufficient_data").when(lifted & (F.abs(mean_in - median_in) < 0.02), "broad_localized_distortion").when(lifted, "few_extreme_loci")
            .when(low_hobs > 0.3, "regional_het_deficit").when(F.abs(gap) < 0.02, "no_signal").otherwise("weak_signal"))


def overlay(candidates: DataFrame, windows_: DataFrame, flank: int = 500_000) -> DataFrame:
    """Candidates (candidate_id, chrom, start, end) against windows: strict overlap is inside, whole windows up to `flank` away are
    beside. Numbers of windows, means of F by side, mean outlier shares inside, and the pattern."""
    wide = candidates.select("candidate_id", "chrom", (F.col("start") - flank).alias("start"), (F.col("end") + flank).alias("end"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    j = overlap_join(wide, windows_.select("chrom", "start", "end", "mean_f", "median_f", "frac_high_f_outlier", "frac_low_hobs_outlier"), 250_000)
    ws, we = F.col("start_r"), F.col("end_r")
    inside = (ws < F.col("ce")) & (we > F.col("cs"))
    beside = ((ws >= F.col("start")) & (we <= F.col("cs"))) | ((ws >= F.col("ce")) & (we <= F.col("end")))
    mean = lambda side, c: F.avg(F.when(side, F.col(c + "_r")))
    g = j.groupBy("candidate_id").agg(F.count(F.when(inside, 1)).alias("n_inside"), F.count(F.when(beside, 1)).alias("n_flank"), mean(inside, "mean_f").alias("mean_f_inside"), mean(inside, "median_f").alias("median_f_inside"), mean(beside, "mean_f").alias("mean_f_flank"), mean(inside, "frac_high_f_outlier").alias("frac_high_f"), mean(inside, "frac_low_hobs_outlier").alias("frac_low_hobs"))
    return candidates.join(g, "candidate_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_inside", "n_flank")}).withColumn("pattern", distortion(F.col("mean_f_inside"), F.col("median_f_inside"), F.col("mean_f_flank"), F.col("frac_high_f"), F.col("frac_low_hobs")))


def burden(windows_: DataFrame) -> DataFrame:
    """Mean outlier shares by scale and chromosome, one row for each measure. Shares are added as decimals, so that the mean does not
    depend on the order of windows."""
    shares = [c for c in windows_.columns if c.startswith("frac_")]
    return windows_.groupBy("scale", "chrom").agg(*[(F.sum(F.col(c).cast("decimal(20,12)")).cast("double") / F.count(c)).alias(c) for c in shares]).unpivot(["scale", "chrom"], shares, "measure", "value")


def subset_summary(sites: DataFrame, by: str, value: str) -> DataFrame:
    """Median and scaled MAD of a value by subset."""
    med = sites.groupBy(by).agg(F.median(value).alias("median"))
    return sites.join(med, by).groupBy(by, "median").agg((1.4826 * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad"))


def binned_pivot(sites: DataFrame, by: str, value: str, size: int, subsets: list[str]) -> DataFrame:
    """Mean of a value by position bin (rounded half to even), a column for each subset."""
    return sites.withColumn("pos_bin", (F.bround(F.col("pos") / size) * size).cast("long")).groupBy("pos_bin").pivot(by, subsets).agg(F.avg(value))


def subset_contrast(sites: DataFrame, by: str, a: str, b: str, size: int) -> DataFrame:
    """Difference of mean hobs and f of two subsets in position bins that both have."""
    m = sites.withColumn("pos_bin", (F.bround(F.col("pos") / size) * size).cast("long")).filter(F.col(by).isin(a, b)).groupBy("pos_bin").agg(*[F.avg(F.when(F.col(by) == s, F.col(v))).alias(f"{v}_{k}") for k, s in (("a", a), ("b", b)) for v in ("hobs", "f")])
    return m.filter("hobs_a is not null and hobs_b is not null").select("pos_bin", (F.col("hobs_a") - F.col("hobs_b")).alias("delta_hobs"), (F.col("f_a") - F.col("f_b")).alias("delta_f"))
