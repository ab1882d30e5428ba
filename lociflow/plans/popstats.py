"""Queries of windowed population statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.expr import sql_erfc
from lociflow.operators import popstats as ps
from lociflow.operators.windows import grid
from lociflow.operators.homologs import karyotypes
from lociflow.plans import adapters as ad

W, S = 50_000, 10_000


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return ps.site_frequencies(ps.dosages(ad.gl(spark, d)))


def _freqs(spark: SparkSession, d: str) -> DataFrame:
    return ps.group_frequencies(ps.dosages(ad.gl(spark, d)), F.broadcast(ad.groups(spark)))


def fst_dxy(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: FST, dXY, dA, MI between all pairs of groups in sliding windows."""
    return rounded(ps.pairwise_divergence(_freqs(spark, d), W, S))


REGION = 200_000


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of REGION positions that cover every chromosome."""
    last = ad.gl(spark, d).groupBy("chrom").agg(F.lit(1).cast("long").alias("start"), F.max("pos").alias("end"))
    return grid(last, REGION, REGION)


QUERIES = {
    "pop_pairwise_divergence": fst_dxy,
    "pop_cohort_diversity": lambda s, d: rounded(ps.cohort_diversity(_sites(s, d), W, S)),
    "pop_group_theta": lambda s, d: rounded(ps.group_diversity(_freqs(s, d), W, S)),
    "pop_variant_groups": lambda s, d: rounded(ps.variant_groups(ps.dosages(ad.gl(s, d)), F.broadcast(ad.groups(s)), "HOM_A", "HET", "HOM_B")),
    "pop_karyotype_hwe": lambda s, d: rounded(ps.karyotype_hwe(karyotypes(ad.gl(s, d), REGION), by=["chrom", "start"])),
    "pop_inbreeding_windows": lambda s, d: rounded(ps.inbreeding_windows(_sites(s, d), W, S), 4),
    "pop_region_stats": lambda s, d: rounded(ps.region_table_stats(ps.dosages(ad.gl(s, d)), _sites(s, d), _regions(s, d))),
    "pop_downsample": lambda s, d: rounded(ps.downsample(_sites(s, d).select("chrom", "pos", "n", "p"), 3, ["pos"])),
    "pop_site_slice": lambda s, d: rounded(ps.site_slice(_sites(s, d).select("chrom", "pos", "n", "p"), 5, 24, ["pos"])),
    "pop_dispatcher_rollup": lambda s, d: rounded(ps.rollup(ps.cohort_diversity(_sites(s, d), W, S), ps.pairwise_divergence(_freqs(s, d), W, S), ["HOM_A", "HET", "HOM_B"])),
}

_SITE = """site AS (SELECT chrom, pos, count(*) AS n, sum(d) / (2 * count(*)) AS p, sum(h) / count(*) AS ho FROM dos GROUP BY chrom, pos),
fis AS (SELECT *, CASE WHEN 2*p*(1-p) > 1e-10 THEN ((2*p*(1-p) - ho) / (2*p*(1-p)))::FLOAT END AS f FROM site)"""
_FREQ = "freq AS (SELECT chrom, pos, g, count(*) AS n, sum(d) / (2 * count(*)) AS p FROM dos JOIN grp USING (s) GROUP BY chrom, pos, g)"
_WIN = f"unnest(range(greatest(0, (pos - {W - 1} + {S - 1}) // {S}), pos // {S} + 1)) * {S}"
_H = "(-(CASE WHEN {0} > 0 THEN {0}*ln({0}) ELSE 0 END) - (CASE WHEN 1-{0} > 0 THEN (1-{0})*ln(1-{0}) ELSE 0 END))"
_PM = "((a.n*a.p + b.n*b.p) / (a.n + b.n))"
_COHORT = f"""w AS (SELECT chrom, start, start + {W - 1} AS "end", count(*) AS n_sites, sum(CASE WHEN n >= 5 THEN 2*p*(1-p)*n/(n-1) END) AS pi, sum(CASE WHEN n >= 5 AND p > 0.01 AND p < 0.99 THEN 1 ELSE 0 END)::BIGINT AS S,
  max(CASE WHEN n >= 5 THEN n END)::DOUBLE AS n, sum(CASE WHEN n >= 5 THEN 2*p*(1-p)*2*n END) / sum(CASE WHEN n >= 5 THEN 2*n END) AS hp FROM (SELECT *, {_WIN} AS start FROM site) GROUP BY chrom, start),
k AS (SELECT *, list_sum([1.0::DOUBLE / x FOR x IN range(1, n::BIGINT)]) AS a1, list_sum([1.0::DOUBLE / (x * x) FOR x IN range(1, n::BIGINT)]) AS a2 FROM w),
v AS (SELECT *, ((n+1)/(3*(n-1)) - 1/a1)/a1 * S + (2*(n*n+n+3)/(9*n*(n-1)) - (n+2)/(a1*n) + a2/(a1*a1))/(a1*a1+a2) * S * (S-1) AS var FROM k),
coh AS (SELECT chrom, start, "end", n_sites, CASE WHEN n_sites >= 5 THEN pi / n_sites ELSE 0 END AS theta_pi, CASE WHEN n_sites >= 5 THEN S ELSE 0 END AS S,
  CASE WHEN n_sites >= 5 THEN S / (a1 * n_sites) ELSE 0 END AS theta_W, CASE WHEN n_sites >= 5 AND S > 1 AND var > 0 THEN (pi - S / a1) / sqrt(var) ELSE 0 END AS Tajima_D, CASE WHEN n_sites >= 5 THEN hp ELSE 0 END AS Hp FROM v)"""
SQL = {
    "pop_pairwise_divergence": ad.with_ctes(ad.SQL_GL, _FREQ) + f"""
, pair AS (SELECT a.chrom, a.pos, a.g AS group_a, b.g AS group_b, (a.p-b.p)*(a.p-b.p) - a.p*(1-a.p)/(a.n-1) - b.p*(1-b.p)/(b.n-1) AS num, a.p*(1-b.p) + b.p*(1-a.p) AS den,
  2*a.p*(1-a.p)*a.n/(a.n-1) AS pa, 2*b.p*(1-b.p)*b.n/(b.n-1) AS pb, {_H.format(_PM)} AS hm,
  greatest(0, {_H.format(_PM)} - (a.n*{_H.format("a.p")} + b.n*{_H.format("b.p")}) / (a.n + b.n)) AS mi FROM freq a JOIN freq b ON a.chrom = b.chrom AND a.pos = b.pos AND a.g < b.g),
w AS (SELECT chrom, start, group_a, group_b, count(*) AS n_sites, sum(num) AS num, sum(den) AS den, sum(pa) AS pa, sum(pb) AS pb, sum(mi) AS mi, sum(hm) AS hm FROM (SELECT *, {_WIN} AS start FROM pair) GROUP BY ALL)
SELECT chrom, start, start + {W - 1} AS "end", group_a, group_b, n_sites, round(CASE WHEN n_sites >= 5 THEN greatest(0, num / den) ELSE 0 END, 6) AS FST, round(CASE WHEN n_sites >= 5 THEN den / n_sites ELSE 0 END, 6) AS dXY,
  round(CASE WHEN n_sites >= 5 THEN den / n_sites - (pa + pb) / 2 / n_sites ELSE 0 END, 6) + 0.0 AS dA, round(CASE WHEN n_sites >= 5 THEN mi / n_sites ELSE 0 END, 6) AS MI, round(CASE WHEN n_sites >= 5 THEN mi / hm ELSE 0 END, 6) AS MInorm FROM w""",
    "pop_cohort_diversity": ad.with_ctes(ad.SQL_GL, _SITE, _COHORT) + 'SELECT chrom, start, "end", n_sites, S, ' + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("theta_pi", "theta_W", "Tajima_D", "Hp")) + " FROM coh",
    "pop_group_theta": ad.with_ctes(ad.SQL_GL, _FREQ) + f"""SELECT chrom, start, start + {W - 1} AS "end", g AS "group", count(*) AS n_sites, round(CASE WHEN count(*) >= 5 THEN sum(CASE WHEN n >= 2 THEN 2*p*(1-p)*n/(n-1) ELSE 0 END) / count(*) ELSE 0 END, 6) AS theta_pi FROM (SELECT *, {_WIN} AS start FROM freq) GROUP BY chrom, start, g""",
    "pop_variant_groups": ad.with_ctes(ad.SQL_GL) + """, g AS (SELECT chrom, pos, g AS "group", count(*) AS n, sum(d) AS sum_dosage, sum(d) / (2 * count(*)) AS freq, avg(peak) AS mean_peak, avg((peak >= 0.85)::INT) AS pass FROM dos JOIN grp USING (s) GROUP BY chrom, pos, g),
x AS (SELECT chrom, pos, max(freq) FILTER ("group" = 'HOM_A') AS fl, max(freq) FILTER ("group" = 'HET') AS fm, max(freq) FILTER ("group" = 'HOM_B') AS fh, min(pass) FILTER ("group" <> 'HET') AS mp FROM g GROUP BY chrom, pos)
SELECT chrom, pos, "group", n, round(sum_dosage, 6) AS sum_dosage, round(freq, 6) AS freq, round(mean_peak, 6) AS mean_peak, round(abs(fl - fh), 6) AS polarisation, fm BETWEEN least(fl, fh) AND greatest(fl, fh) AS het_intermediate, mp >= 0.80 AS gl_peak_pass FROM g JOIN x USING (chrom, pos)""",
    "pop_karyotype_hwe": ad.with_ctes(ad.SQL_GL) + f"""
, ls AS (SELECT chrom, pos // {REGION} * {REGION} AS start, s, {", ".join(f"round(sum(ln(greatest(gl{k} / (gl0 + gl1 + gl2), 1e-10))), 6) AS l{k}" for k in range(3))} FROM gl GROUP BY ALL),
ky AS (SELECT chrom, start, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'HOM_A' WHEN l1 >= l2 THEN 'HET' ELSE 'HOM_B' END AS g FROM ls),
c AS (SELECT chrom, start, count(*) FILTER (g = 'HOM_A')::DOUBLE AS a, count(*) FILTER (g = 'HET')::DOUBLE AS h, count(*) FILTER (g = 'HOM_B')::DOUBLE AS b, count(*)::DOUBLE AS n FROM ky GROUP BY ALL),
e AS (SELECT *, (2*a+h)/(2*n) AS p FROM c), f AS (SELECT *, 2*p*(1-p) AS hexp, h/n AS hobs, CASE WHEN n*p*p > 0 THEN (a-n*p*p)*(a-n*p*p)/(n*p*p) ELSE 0 END + CASE WHEN 2*n*p*(1-p) > 0 THEN (h-2*n*p*(1-p))*(h-2*n*p*(1-p))/(2*n*p*(1-p)) ELSE 0 END + CASE WHEN n*(1-p)*(1-p) > 0 THEN (b-n*(1-p)*(1-p))*(b-n*(1-p)*(1-p))/(n*(1-p)*(1-p)) ELSE 0 END AS chi2 FROM e),
i AS (SELECT *, CASE WHEN hexp > 0 THEN 1-hobs/hexp ELSE 0 END AS fis FROM f)
SELECT chrom, start, n::BIGINT AS n, round(hobs, 6) AS hobs, round(hexp, 6) AS hexp, round(fis, 6) + 0.0 AS fis, round(chi2, 6) AS chi2, round({sql_erfc("sqrt(chi2/2)")}, 6) AS p, CASE WHEN fis <= -0.1 THEN 'HET_excess' WHEN fis >= 0.1 THEN 'HET_deficit' ELSE 'HWE_like' END AS label FROM i""",
    "pop_inbreeding_windows": ad.with_ctes(ad.SQL_GL, _SITE) + f""", r AS (SELECT chrom, pos, f, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY f) AS t FROM fis WHERE f IS NOT NULL),
a AS (SELECT count(*)::DOUBLE AS nn, sum((t * t - 1)::DOUBLE) AS tie FROM r),
w AS (SELECT chrom, start, count(*) AS n, avg(f::DOUBLE) AS mean, coalesce(stddev_samp(f::DOUBLE), 0) AS sd, sum(rk) AS rs FROM (SELECT *, {_WIN} AS start FROM r) GROUP BY chrom, start),
u AS (SELECT *, rs - n * (n + 1) / 2.0::DOUBLE AS u, n * (nn - n) / 12 * ((nn + 1) - tie / (nn * (nn - 1))) AS var, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t FROM w, a),
z AS (SELECT *, CASE WHEN var > 0 THEN (u - n * (nn - n) / 2) / sqrt(var) END AS z FROM u)
SELECT chrom, start, start + {W - 1} AS "end", n, round(mean, 4) + 0.0 AS mean, round(sd, 4) AS sd, round(t, 4) + 0.0 AS t, n - 1 AS df, round(CASE WHEN t IS NOT NULL THEN {sql_erfc("abs(t)/sqrt(2.0::double)")} END, 4) AS t_p, CASE WHEN nn > n THEN round(u, 4) END AS U, CASE WHEN nn > n THEN round(z, 4) + 0.0 END AS z, CASE WHEN nn > n AND z IS NOT NULL THEN round({sql_erfc("abs(z)/sqrt(2.0::double)")}, 4) END AS u_p FROM z""",
    "pop_region_stats": ad.with_ctes(ad.SQL_GL, _SITE) + f""", s AS (SELECT chrom, (pos - 1) // {REGION} AS b, count(*) AS n_sites, round(avg(2*p*(1-p)*n/(n-1)), 6) AS theta_pi, round(avg((f < 0)::INT), 6) AS hwe_excess FROM fis GROUP BY ALL),
h AS (SELECT chrom, (pos - 1) // {REGION} AS b, s, avg((d BETWEEN 0.3 AND 1.7)::INT) AS h FROM dos GROUP BY ALL), hh AS (SELECT chrom, b, round(avg(h), 6) AS hobs_mean, round(stddev_pop(h), 6) AS hobs_sd FROM h GROUP BY ALL)
SELECT chrom, b * {REGION} + 1 AS start, (b + 1) * {REGION} AS "end", n_sites, theta_pi, hwe_excess, hobs_mean, hobs_sd FROM s JOIN hh USING (chrom, b)""",
    "pop_downsample": ad.with_ctes(ad.SQL_GL, _SITE) + "SELECT chrom, pos, n, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i FROM site) WHERE i % 3 = 0",
    "pop_site_slice": ad.with_ctes(ad.SQL_GL, _SITE) + "SELECT chrom, pos, n, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i FROM site) WHERE i BETWEEN 5 AND 24",
}
_ALL = SQL["pop_pairwise_divergence"]
_at = _ALL.rindex("SELECT chrom, start, start +")
SQL["pop_dispatcher_rollup"] = _ALL[:_at].rstrip().replace("\nw AS (", "\npw AS (") + ", " + _SITE + ", " + _COHORT + """, pm AS (SELECT chrom, group_a || '_' || group_b AS ab, avg(CASE WHEN n_sites >= 5 THEN greatest(0, num / den) ELSE 0 END) AS f, avg(CASE WHEN n_sites >= 5 THEN den / n_sites ELSE 0 END) AS x FROM pw GROUP BY ALL),
cm AS (SELECT chrom, """ + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in ("theta_pi", "theta_W", "Tajima_D", "Hp")) + " FROM coh GROUP BY chrom) SELECT cm.*, " + ", ".join(f"(SELECT round({v}, 6) FROM pm WHERE pm.chrom = cm.chrom AND ab = '{p}') AS {n}_{p}" for n, v in (("Fst", "f"), ("dXY", "x")) for p in ("HET_HOM_A", "HET_HOM_B", "HOM_A_HOM_B")) + " FROM cm"
