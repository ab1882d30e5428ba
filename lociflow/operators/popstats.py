"""Windowed diversity and differentiation from genotype likelihoods.

Genotypes are reduced to site sums before windows multiply them. p is the alternative allele's frequency and n the number of
individuals in every small-sample term. Statistics that cannot be computed are 0, with n_sites beside them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import expr
from lociflow.operators.windows import bucketed, fixed_grid, numbered, points_in, running

MIN_SITES, MIN_INDIVIDUALS = 5, 5
WIN = ["chrom", "start", "end"]


def dosages(gl: DataFrame) -> DataFrame:
    """chrom, pos, sample_idx, dosage (of normalised likelihoods), peak, het (share of the middle genotype)."""
    total = F.col("gl0") + F.col("gl1") + F.col("gl2")
    safe = F.when(total > 1e-15, total)
    return gl.select("chrom", "pos", "sample_idx", F.coalesce((F.col("gl1") + 2 * F.col("gl2")) / safe, F.lit(0.0)).alias("dosage"), F.coalesce(F.greatest("gl0", "gl1", "gl2") / safe, F.lit(0.0)).alias("peak"), F.coalesce(F.col("gl1") / safe, F.lit(0.0)).alias("het"))


def downsample(sites: DataFrame, every: int, order: list[str]) -> DataFrame:
    """Every n-th site of a chromosome, by its number before other filters."""
    return numbered(sites, order).filter(F.col("_i") % every == 0).drop("_i", "_n")


def site_slice(sites: DataFrame, first: int, last: int, order: list[str]) -> DataFrame:
    """The sites numbered first to last (both included, from 0) of each chromosome, after all other filters."""
    return numbered(sites, order).filter(F.col("_i").between(first, last)).drop("_i", "_n")


def site_frequencies(dos: DataFrame) -> DataFrame:
    """chrom, pos, n, p, fis: inbreeding at the site as a 32-bit number, null where no heterozygotes are expected."""
    s = dos.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("dosage").alias("d"), F.sum("het").alias("h"))
    p = F.col("d") / (2 * F.col("n"))
    he = 2 * p * (1 - p)
    return s.select("chrom", "pos", "n", p.alias("p"), F.when(he > 1e-10, (he - F.col("h") / F.col("n")) / he).cast("float").alias("fis"))


def group_frequencies(dos: DataFrame, groups: DataFrame) -> DataFrame:
    """chrom, pos, group, n, p. groups (group, sample_idx) is a table of samples."""
    return dos.join(groups, "sample_idx").groupBy("chrom", "pos", "group").agg(F.count(F.lit(1)).alias("n"), (F.sum("dosage") / (2 * F.count(F.lit(1)))).alias("p"))


def harmonic(n: Column, power: int = 1) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))), F.lit(0.0), lambda a, k: a + 1.0 / F.pow(k, F.lit(power)))


def cohort_diversity(sites: DataFrame, width: int, step: int) -> DataFrame:
    """A01, A02 by window: n_sites, theta_pi, S, theta_W, Tajima_D, Hp."""
    used = F.col("n") >= MIN_INDIVIDUALS
    pi = 2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)
    w = fixed_grid(sites, width, step).groupBy(*WIN).agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum(F.when(used, pi)).alias("pi"), F.sum(F.when(used & (F.col("p") > 0.01) & (F.col("p") < 0.99), 1).otherwise(0)).alias("S"),
        F.max(F.when(used, F.col("n"))).alias("n"), (F.sum(F.when(used, 2 * F.col("p") * (1 - F.col("p")) * 2 * F.col("n"))) / F.sum(F.when(used, 2 * F.col("n")))).alias("hp"))
    n, s, a1, a2 = F.col("n").cast("double"), F.col("S").cast("double"), harmonic(F.col("n")), harmonic(F.col("n"), 2)
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1 = b1 - 1 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    var = c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)
    ok = (F.col("n_sites") >= MIN_SITES) & F.col("n").isNotNull()
    zero = lambda c, cond=ok: F.coalesce(F.when(cond, c), F.lit(0.0))
    return w.select(*WIN, "n_sites", zero(F.col("pi") / F.col("n_sites")).alias("theta_pi"), F.when(ok, F.col("S")).otherwise(0).cast("long").alias("S"), zero(s / (a1 * F.col("n_sites"))).alias("theta_W"), zero((F.col("pi") - s / a1) / F.sqrt(var), ok & (s > 1) & (n > 2) & (var > 0)).alias("Tajima_D"), zero(F.col("hp")).alias("Hp"))


def group_diversity(freqs: DataFrame, width: int, step: int) -> DataFrame:
    """theta_pi by window and group, over all sites of the window."""
    pi = F.when(F.col("n") >= 2, 2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)).otherwise(0.0)
    w = fixed_grid(freqs, width, step).groupBy(*WIN, "group").agg(F.count(F.lit(1)).alias("n_sites"), F.sum(pi).alias("pi"))
    return w.select(*WIN, "group", "n_sites", F.when(F.col("n_sites") >= MIN_SITES, F.col("pi") / F.col("n_sites")).otherwise(0.0).alias("theta_pi"))


def _h(p: Column) -> Column:
    q = 1 - p
    return -F.when(p > 0, p * F.log(p)).otherwise(0.0) - F.when(q > 0, q * F.log(q)).otherwise(0.0)


def pairwise_divergence(freqs: DataFrame, width: int, step: int) -> DataFrame:
    """A04 by window and pair of groups a < b: Hudson's FST, dXY, dA, MI and MInorm. The groups of a site meet inside it."""
    both = freqs.groupBy("chrom", "pos").agg(F.sort_array(F.collect_list(F.struct("group", "n", "p"))).alias("g"))
    pair = both.select("chrom", "pos", F.posexplode("g").alias("i", "a"), "g").select("chrom", "pos", "a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    n1, n2, p1, p2 = F.col("a.n"), F.col("b.n"), F.col("a.p"), F.col("b.p")
    q1, q2 = 1 - p1, 1 - p2
    num = (p1 - p2) * (p1 - p2) - p1 * q1 / (n1 - 1) - p2 * q2 / (n2 - 1)
    mean = (n1 * p1 + n2 * p2) / (n1 + n2)
    mi = F.greatest(F.lit(0.0), _h(mean) - (n1 * _h(p1) + n2 * _h(p2)) / (n1 + n2))
    fair = (n1 >= 2) & (n2 >= 2)
    val = lambda c: F.when(fair, c).otherwise(0.0)
    pi = lambda p, n: 2 * p * (1 - p) * n / (n - 1)
    rows = pair.select("chrom", "pos", F.col("a.group").alias("group_a"), F.col("b.group").alias("group_b"), val(num).alias("num"), val(p1 * q2 + p2 * q1).alias("den"), val(pi(p1, n1)).alias("pa"), val(pi(p2, n2)).alias("pb"), val(mi).alias("mi"), val(_h(mean)).alias("hm"))
    w = fixed_grid(rows, width, step).groupBy(*WIN, "group_a", "group_b").agg(F.count(F.lit(1)).alias("n_sites"), *[F.sum(c).alias(c) for c in ("num", "den", "pa", "pb", "mi", "hm")])
    ok = F.col("n_sites") >= MIN_SITES
    zero = lambda c, cond=ok: F.when(ok & cond, c).otherwise(0.0)
    dxy = F.col("den") / F.col("n_sites")
    return w.select(*WIN, "group_a", "group_b", "n_sites", zero(F.greatest(F.lit(0.0), F.col("num") / F.col("den")), F.col("den") > 1e-15).alias("FST"), zero(dxy).alias("dXY"), zero(dxy - (F.col("pa") + F.col("pb")) / 2 / F.col("n_sites")).alias("dA"), zero(F.col("mi") / F.col("n_sites")).alias("MI"), zero(F.col("mi") / F.col("hm"), F.col("hm") > 1e-15).alias("MInorm"))


def variant_groups(dos: DataFrame, groups: DataFrame, low: str, middle: str, high: str, peak: float = 0.85, share: float = 0.80) -> DataFrame:
    """N, sum of dosage, frequency and mean peak by variant and group, with the variant's polarisation, whether the middle
    group lies between, and whether peaks pass in both outer groups."""
    g = dos.join(groups, "sample_idx").groupBy("chrom", "pos", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("dosage").alias("sum_dosage"), (F.sum("dosage") / (2 * F.count(F.lit(1)))).alias("freq"), F.avg("peak").alias("mean_peak"), F.avg((F.col("peak") >= peak).cast("int")).alias("_pass"))
    of = lambda name: F.max(F.when(F.col("group") == name, F.col("freq")))
    site = g.groupBy("chrom", "pos").agg(of(low).alias("fl"), of(middle).alias("fm"), of(high).alias("fh"), F.min(F.when(F.col("group").isin(low, high), F.col("_pass"))).alias("mp"))
    known = site.select("chrom", "pos", F.abs(F.col("fl") - F.col("fh")).alias("polarisation"), F.col("fm").between(F.least("fl", "fh"), F.greatest("fl", "fh")).alias("het_intermediate"), (F.col("mp") >= share).alias("gl_peak_pass"))
    return g.drop("_pass").join(known, ["chrom", "pos"])


def karyotype_hwe(groups: DataFrame, low: str = "HOM_A", middle: str = "HET", high: str = "HOM_B", threshold: float = 0.10, by: list[str] | None = None) -> DataFrame:
    """N, hobs, hexp, fis, chi2, p, label: one row, or one for each key of by."""
    by = by or []
    c = groups.groupBy(*by).agg(*[F.sum((F.col("group") == g).cast("long")).cast("double").alias(x) for g, x in ((low, "a"), (middle, "h"), (high, "b"))])
    n = F.col("a") + F.col("h") + F.col("b")
    p = (2 * F.col("a") + F.col("h")) / (2 * n)
    q = 1 - p
    part = lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)
    chi = part(F.col("a"), n * p * p) + part(F.col("h"), 2 * n * p * q) + part(F.col("b"), n * q * q)
    fis = F.when(2 * p * q > 0, 1 - F.col("h") / n / (2 * p * q)).otherwise(0.0)
    return c.select(*by, n.cast("long").alias("n"), (F.col("h") / n).alias("hobs"), (2 * p * q).alias("hexp"), fis.alias("fis"), chi.alias("chi2"), expr.chi2_p(chi).alias("p"), expr.fis_label(fis, threshold).alias("label"))


def ranked(values: DataFrame, value: str = "fis") -> DataFrame:
    """Values with their average rank over the whole table. Distinct values are counted and their running count is made by buckets of
    values, so that no task ranks all rows; ranks are joined back."""
    some = values.filter(F.col(value).isNotNull())
    d = some.groupBy(value).agg(F.count(F.lit(1)).alias("_t"))
    r = running(bucketed(d, value), value, "_t").select(F.col(value).alias("_v"), (F.col("_run") - F.col("_t") + (F.col("_t") + 1) / 2).alias("rank"), F.col("_t").alias("ties"))
    return some.join(r, some[value] == F.col("_v")).drop("_v")


def inbreeding_windows(sites: DataFrame, width: int, step: int) -> DataFrame:
    """By window n, mean, sample sd, t and p of the sites' F_IS, and U, z, p of the rank sum against all other sites."""
    r = ranked(sites.select("chrom", "pos", "fis"))
    all_ = r.agg(F.count(F.lit(1)).cast("double").alias("total"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie"))
    w = fixed_grid(r, width, step).groupBy(*WIN).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("fis").cast("double")).alias("mean"), F.coalesce(F.stddev_samp(F.col("fis").cast("double")), F.lit(0.0)).alias("sd"), F.sum("rank").alias("R")).crossJoin(F.broadcast(all_))
    n1, n2 = F.col("n").cast("double"), F.col("total") - F.col("n")
    u = F.col("R") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((F.col("total") + 1) - F.col("tie") / (F.col("total") * (F.col("total") - 1)))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt(n1)))
    z = F.when(var > 0, (u - n1 * n2 / 2) / F.sqrt(var))
    return w.select(*WIN, "n", "mean", "sd", t.alias("t"), (F.col("n") - 1).alias("df"), expr.normal_p(t).alias("t_p"), F.when(n2 > 0, u).alias("U"), F.when(n2 > 0, z).alias("z"), F.when(n2 > 0, expr.normal_p(z)).alias("u_p"))


def region_stats(dos: DataFrame, sites: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """One region's n_sites, theta_pi, share of sites with more heterozygotes than expected, and mean and sd over samples of the
    share of intermediate dosages."""
    here = (F.col("chrom") == chrom) & F.col("pos").between(start, end)
    s = sites.filter(here).agg(F.count(F.lit(1)).alias("n_sites"), F.avg(2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)).alias("theta_pi"), F.avg((F.col("fis") < 0).cast("int")).alias("hwe_excess"))
    h = dos.filter(here).groupBy("sample_idx").agg(F.avg(F.col("dosage").between(0.3, 1.7).cast("int")).alias("h")).agg(F.avg("h").alias("hobs_mean"), F.stddev_pop("h").alias("hobs_sd"))
    return s.crossJoin(h)


def region_table_stats(dos: DataFrame, sites: DataFrame, regions: DataFrame) -> DataFrame:
    """A33 for a table of regions (chrom, start, end) at once: positions meet regions by bins, then one aggregation for each region."""
    r = regions.select("chrom", "start", "end")
    s = points_in(sites, r, 100_000).groupBy(*WIN).agg(F.count(F.lit(1)).alias("n_sites"), F.avg(2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)).alias("theta_pi"), F.avg((F.col("fis") < 0).cast("int")).alias("hwe_excess"))
    h = points_in(dos, r, 100_000).groupBy(*WIN, "sample_idx").agg(F.avg(F.col("dosage").between(0.3, 1.7).cast("int")).alias("h")).groupBy(*WIN).agg(F.avg("h").alias("hobs_mean"), F.stddev_pop("h").alias("hobs_sd"))
    return s.join(h, WIN)


def rollup(windows: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """Means over the windows of a chromosome: theta_pi, theta_W, Tajima_D, Hp, and Fst_a_b and dXY_a_b of every pair of the named groups."""
    both = [(a, b) for i, a in enumerate(sorted(names)) for b in sorted(names)[i + 1 :]]
    flat = pairs.groupBy("chrom").agg(*[F.avg(F.when((F.col("group_a") == a) & (F.col("group_b") == b), F.col(c))).alias(f"{n}_{a}_{b}") for n, c in (("Fst", "FST"), ("dXY", "dXY")) for a, b in both])
    return windows.groupBy("chrom").agg(*[F.avg(c).alias(c) for c in ("theta_pi", "theta_W", "Tajima_D", "Hp")]).join(flat, "chrom", "left")
