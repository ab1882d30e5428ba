"""Queries on tracks and heterozygosity windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.expr import sql_erfc
from lociflow.operators import hobs, scan
from lociflow.operators.windows import nearest
from lociflow.plans import adapters as ad
from lociflow.plans.popstats import rounded

DAY = 86_400
CUT, STRONG, GAP = 52.0, 55.0, 40_000
GENOME = 5 * 31 * DAY


def candidates(spark: SparkSession) -> DataFrame:
    """Two fixed candidates on each chromosome of the track."""
    rows = [(f"{c}_{k}", c, k * 10 * DAY, k * 10 * DAY + 4 * DAY) for c in ad.TRACK_CHROMS for k in (1, 2)]
    return spark.createDataFrame(rows, "candidate_id string, chrom string, start long, end long")


def _outliers(spark: SparkSession, d: str) -> DataFrame:
    return scan.flagged(ad.track(spark, d), CUT)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return scan.regions(_outliers(spark, d), GAP, "high", STRONG)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_summary(ad.track(spark, d), _outliers(spark, d), _regions(spark, d), GENOME)


def _flanks(spark: SparkSession, d: str, exclude: bool = False) -> DataFrame:
    return scan.candidates_against_flanks(candidates(spark), ad.track(spark, d).withColumn("depth", F.col("n_variants")), ["stat", "depth"], 5 * DAY, exclude)


def _hobs(spark: SparkSession, d: str) -> DataFrame:
    return hobs.heterozygosity(ad.hwe_sites(spark, d))


def _hobs_windows(spark: SparkSession, d: str) -> DataFrame:
    return hobs.windows(_hobs(spark, d))


def hobs_candidates(spark: SparkSession) -> DataFrame:
    rows = [(f"{c[0]}_{k}", c, k * 4000 + 1, k * 4000 + 3000) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for k in (0, 1, 2)]
    return spark.createDataFrame(rows, "candidate_id string, chrom string, start long, end long")


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    small = hobs.windows(_hobs(spark, d), (("1kb", 1_000, 200),), 1.0).drop("scale")
    return hobs.overlay(hobs_candidates(spark), small, 2_000)


def _user_days(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of many small regions: one for each user."""
    return ad.table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), F.col("value").alias("v"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "events").select("event_type", "event_id", F.col("value").alias("v"))


QUERIES = {
    "track_windows": lambda s, d: rounded(ad.track(s, d)),
    "scan_outlier_regions": lambda s, d: rounded(_regions(s, d)),
    "scan_top_percent": lambda s, d: rounded(scan.flagged(ad.track(s, d), direction="high", top_percent=5)),
    "scan_summary": lambda s, d: rounded(_summary(s, d)),
    "scan_nearest_gene": lambda s, d: nearest(_regions(s, d).select("chrom", "region", "start", "end"), ad.genes(s, d), ["chrom", "region"]),
    "scan_region_overlap_flag": lambda s, d: scan.annotated(_regions(s, d).select("chrom", "region", "start", "end"), candidates(s), "in_candidate"),
    "scan_candidates_vs_flanks": lambda s, d: rounded(_flanks(s, d), 5),
    "scan_candidates_excluding_overlaps": lambda s, d: rounded(_flanks(s, d, True), 5),
    "scan_regions_vs_rest": lambda s, d: rounded(scan.regions_against_rest(ad.track(s, d), ["stat", "n_variants"], "chrom"), 5),
    "scan_region_permutations": lambda s, d: rounded(scan.regions_against_rest(ad.track(s, d), ["stat", "n_variants"], "chrom", permutations=1000), 5),
    "scan_users_vs_rest": lambda s, d: rounded(scan.regions_against_rest(_user_days(s, d), ["v"], "user"), 5),
    "scan_permutation_test": lambda s, d: rounded(scan.candidates_against_flanks(candidates(s), ad.track(s, d), ["stat"], 5 * DAY, permutations=1000), 5),
    "scan_bootstrap_mean": lambda s, d: rounded(scan.bootstrap(ad.track(s, d).withColumn("v", F.col("stat")), ["chrom"], ["start"], replicates=1000), 5),
    "scan_bootstrap_block_median": lambda s, d: rounded(scan.bootstrap(ad.track(s, d).withColumn("v", F.col("stat")), ["chrom"], ["start"], replicates=1000, block=4, statistic="median"), 5),
    "scan_binned_z": lambda s, d: rounded(scan.z_scores(ad.track(s, d).withColumn("bin", F.floor(F.col("n_variants") / 10)), "stat", ["bin"]), 5),
    "hobs_windows": lambda s, d: rounded(_hobs_windows(s, d)),
    "hobs_overlay": lambda s, d: rounded(_overlay(s, d)),
    "hobs_burden": lambda s, d: rounded(hobs.burden(_hobs_windows(s, d))),
    "hobs_subset_summary": lambda s, d: rounded(hobs.subset_summary(_hobs(s, d), "chrom", "hobs")),
    "hobs_subset_contrast": lambda s, d: rounded(hobs.subset_contrast(_hobs(s, d), "chrom", "1-URGENT", "5-LOW", 1000)),
    "hobs_binned_pivot": lambda s, d: rounded(hobs.binned_pivot(_hobs(s, d), "chrom", "hobs", 1000, ["1-URGENT", "5-LOW"]).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})),
    "hobs_groups": lambda s, d: rounded(hobs.group_hobs(_dos(s, d), F.broadcast(ad.groups(s)), 50_000, 10_000)),
}


def _dos(spark: SparkSession, d: str) -> DataFrame:
    from lociflow.operators.popstats import dosages

    return dosages(ad.gl(spark, d))


_T = ad.with_ctes(ad.SQL_TRACK)
_REG = f""", o AS (SELECT * FROM track WHERE stat >= {CUT}), b AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o),
m AS (SELECT *, sum(CASE WHEN pe IS NULL OR start - pe > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING)::BIGINT AS region FROM b),
reg AS (SELECT chrom, region, min(start) AS start, max("end") AS "end", count(*) AS n_windows, round(avg(stat), 6) AS mean, round(median(stat), 6) AS median, round(max(stat), 6) AS "max", round(min(stat), 6) AS "min", sum(n_variants)::BIGINT AS n_variants, max("end") - min(start) + 1 AS length, max(stat) >= {STRONG} AS strong FROM m GROUP BY chrom, region)"""
_CAND = ", cand(candidate_id, chrom, start, \"end\") AS (VALUES " + ", ".join(f"('{c}_{k}', '{c}', {k * 10 * DAY}, {k * 10 * DAY + 4 * DAY})" for c in ad.TRACK_CHROMS for k in (1, 2)) + ")"


def _tests(keys: str, p: str = "") -> str:
    """Tests over a CTE x(keys, v, inside)."""
    return f""", rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY {keys}, v) AS t FROM x),
g AS (SELECT {keys}, count(*) FILTER (inside)::DOUBLE AS n1, count(*) FILTER (NOT inside)::DOUBLE AS n2, avg(v) FILTER (inside) AS m1, avg(v) FILTER (NOT inside) AS m2, median(v) FILTER (inside) AS d1, median(v) FILTER (NOT inside) AS d2, sum(rank) FILTER (inside) AS r, sum((t*t-1)::DOUBLE) AS tie FROM rk GROUP BY ALL),
u AS (SELECT *, n1 >= 2 AND n2 >= 2 AS ok, r - n1*(n1+1)/2 AS u, n1*n2/12*(n1+n2+1 - tie/((n1+n2)*(n1+n2-1))) AS var FROM g), z AS (SELECT *, CASE WHEN ok AND var > 0 THEN (u - n1*n2/2)/sqrt(var) END AS z FROM u)
SELECT {keys}, n1::BIGINT AS n_inside, n2::BIGINT AS n_outside, round(m1, 5) AS mean_inside, round(m2, 5) AS mean_outside, round(d1, 5) AS median_inside, round(d2, 5) AS median_outside, round(m1 - m2, 5) + 0.0 AS effect, CASE WHEN ok THEN round(u, 5) END AS U, round(z, 5) + 0.0 AS z,
 round(CASE WHEN z IS NOT NULL THEN {sql_erfc("abs(z)/sqrt(2.0::double)")} END, 5) AS p, CASE WHEN NOT ok THEN 'NA' WHEN m1 > m2 THEN 'inside_higher' WHEN m1 < m2 THEN 'inside_lower' ELSE 'same' END AS direction FROM z"""


_LONG = ", lg AS (SELECT chrom, start, \"end\", 'stat' AS stat_name, stat AS v FROM track UNION ALL SELECT chrom, start, \"end\", {0}, n_variants::DOUBLE FROM track)"
_FL = f", x AS (SELECT c.candidate_id, l.stat_name, l.v, (l.start + l.\"end\") // 2 BETWEEN c.start AND c.\"end\" AS inside FROM cand c JOIN lg l ON l.chrom = c.chrom AND (l.start + l.\"end\") // 2 BETWEEN c.start - {5 * DAY} AND c.\"end\" + {5 * DAY}" + " {0})"


def _boot(reps: int, block: int, pick: str) -> str:
    return f""", ix AS (SELECT chrom, stat AS v, row_number() OVER (PARTITION BY chrom ORDER BY start) - 1 AS i FROM track), n AS (SELECT chrom, count(*) AS n, {pick}(v) AS observed FROM ix GROUP BY chrom),
dr AS (SELECT chrom, n, rep, d, concat('0x', substr(md5(concat_ws('|', 'boot', chrom, rep::VARCHAR, d::VARCHAR)), 1, 8))::UBIGINT % greatest(n - {block} + 1, 1) AS s FROM (SELECT chrom, n, rep, unnest(range(0, ceil(n / {float(block)})::BIGINT)) AS d FROM (SELECT chrom, n, unnest(range(1, {reps} + 1)) AS rep FROM n))),
rp AS (SELECT a.chrom, rep, {pick}(v) AS b FROM (SELECT *, s::BIGINT + unnest(range(0, {block})) AS i FROM dr) a JOIN ix USING (chrom, i) GROUP BY a.chrom, rep), so AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY b) - 1 AS k, count(*) OVER (PARTITION BY chrom) AS c FROM rp)
SELECT n.chrom, n, round(observed, 5) AS observed, round(avg(b), 5) AS boot_mean, round(stddev_samp(b), 5) AS boot_sd, round(max(b) FILTER (k = floor(0.025 * (c - 1) + 0.5)), 5) AS ci_low, round(max(b) FILTER (k = floor(0.975 * (c - 1) + 0.5)), 5) AS ci_high FROM so JOIN n USING (chrom) GROUP BY n.chrom, n, observed"""


_HO = ad.with_ctes(ad.SQL_HWE) + ", ho AS (SELECT *, 2*freq*(1-freq) AS hexp, least(1, greatest(0, 2*freq*(1-freq)*(1-f))) AS hobs FROM hwe)"


def _hw(scales: tuple, mads: float) -> str:
    stats = ", ".join(f"round({f}({c}), 6) + 0.0 AS {k}_{c}" for c in ("hobs", "f") for k, f in (("mean", "avg"), ("median", "median"), ("sd", "stddev_pop"), ("min", "min"), ("max", "max")))
    names = (("low_hobs", "hobs < hl"), ("high_hobs", "hobs > hh"), ("low_f", "f < fl"), ("high_f", "f > fh"))
    flags = ", ".join(f"count(*) FILTER ({c}) AS n_{x}_outlier, round(avg(({c})::INT), 6) AS frac_{x}_outlier" for x, c in names)
    sets = " UNION ALL ".join(f"SELECT '{n}' AS scale, {w} AS width, unnest(range(greatest(0, (pos - 1 - {w - 1} + {s - 1}) // {s}), (pos - 1) // {s} + 1)) * {s} + 1 AS start, ho.* FROM ho WHERE pos >= 1" for n, w, s in scales)
    return f""", md AS (SELECT median(hobs) AS mh, median(f) AS mf FROM ho), dv AS (SELECT mh, mf, median(abs(hobs - mh)) * {mads} * 1.4826 AS dh, median(abs(f - mf)) * {mads} * 1.4826 AS df FROM ho, md GROUP BY ALL), lim AS (SELECT mh - dh AS hl, mh + dh AS hh, mf - df AS fl, mf + df AS fh FROM dv),
lst AS (SELECT chrom, max(pos) AS lp FROM ho GROUP BY chrom), hw AS (SELECT scale, chrom, start, least(start + width - 1, lp) AS "end", count(*) AS n_sites, {stats}, {flags} FROM ({sets}) q JOIN lst USING (chrom), lim GROUP BY scale, chrom, start, width, lp)"""


SQL = {
    "track_windows": _T + 'SELECT chrom, start, "end", round(stat, 6) AS stat, n_variants FROM track',
    "scan_outlier_regions": _T + _REG + "SELECT * FROM reg",
    "scan_top_percent": _T + ", c AS (SELECT stat AS cut FROM (SELECT stat, row_number() OVER (ORDER BY stat) - 1 AS i, count(*) OVER () AS n FROM track) WHERE i = floor((1 - 5 / 100.0::DOUBLE) * (n - 1))) SELECT chrom, start, \"end\", round(stat, 6) AS stat, n_variants FROM track, c WHERE stat >= cut",
    "scan_summary": _T + _REG + f"SELECT (SELECT count(*) FROM track) AS n_windows, (SELECT count(*) FROM o) AS n_outlier_windows, count(*) AS n_regions, count(*) FILTER (strong) AS n_strong, sum(length)::BIGINT AS outlier_bp, coalesce(sum(length) FILTER (strong), 0)::BIGINT AS strong_bp, round(100.0 * sum(length) / {GENOME}, 6) AS outlier_percent FROM reg",
    "scan_nearest_gene": _T.replace("WITH ", "WITH " + ad.SQL_GENES + ",\n", 1) + _REG + """, d AS (SELECT r.chrom, region, r.start, r."end", gene_id, CASE WHEN (r.start + r."end") // 2 BETWEEN g.start AND g."end" THEN 0 WHEN (r.start + r."end") // 2 < g.start THEN g.start - (r.start + r."end") // 2 ELSE (r.start + r."end") // 2 - g."end" END AS dist, g.ord FROM reg r LEFT JOIN genes g ON g.chrom = r.chrom)
SELECT chrom, region, start, "end", gene_id AS nearest_gene, dist AS gene_distance FROM (SELECT *, row_number() OVER (PARTITION BY chrom, region ORDER BY dist, ord) AS k FROM d) WHERE k = 1""",
    "scan_region_overlap_flag": _T + _REG + _CAND + 'SELECT chrom, region, start, "end", EXISTS (SELECT 1 FROM cand c WHERE c.chrom = reg.chrom AND c.start <= reg."end" AND c."end" >= reg.start) AS in_candidate FROM reg',
    "scan_candidates_vs_flanks": _T + _CAND + _LONG.format("'depth'") + _FL.format("") + _tests("candidate_id, stat_name"),
    "scan_candidates_excluding_overlaps": _T + _CAND + _LONG.format("'depth'") + _FL.format('WHERE (l.start + l."end") // 2 BETWEEN c.start AND c."end" OR NOT EXISTS (SELECT 1 FROM cand q WHERE q.chrom = c.chrom AND q.candidate_id <> c.candidate_id AND l.start <= q."end" AND l."end" >= q.start)') + _tests("candidate_id, stat_name"),
    "scan_regions_vs_rest": _T + _LONG.format("'n_variants'") + ", x AS (SELECT t.chrom AS target, stat_name, v, l.chrom = t.chrom AS inside FROM lg l, (SELECT DISTINCT chrom FROM track) t)" + _tests("target, stat_name"),
    "scan_users_vs_rest": "WITH lg AS (SELECT user_id::VARCHAR AS u, value AS v FROM events), x AS (SELECT t.u AS target, 'v' AS stat_name, v, lg.u = t.u AS inside FROM lg, (SELECT DISTINCT u FROM lg) t)" + _tests("target, stat_name"),
    "scan_bootstrap_mean": _T + _boot(1000, 1, "avg"),
    "scan_bootstrap_block_median": _T + _boot(1000, 4, "median"),
    "scan_binned_z": _T + ", s AS (SELECT n_variants // 10 AS bin, avg(stat) AS m, stddev_samp(stat) AS sd FROM track GROUP BY 1) SELECT chrom, start, \"end\", round(stat, 5) AS stat, n_variants, bin, round((stat - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) + 0.0 AS stat_norm FROM track JOIN s ON s.bin = n_variants // 10",
    "hobs_windows": _HO + _hw(hobs.SCALES, 3.0) + "SELECT * FROM hw",
    "hobs_burden": _HO + _hw(hobs.SCALES, 3.0).replace(", 6) AS frac", ", 15) AS frac") + " SELECT scale, chrom, measure, round(sum(v::DECIMAL(20, 12))::DOUBLE / count(*), 6) AS value FROM (UNPIVOT (SELECT scale, chrom, frac_low_hobs_outlier, frac_high_hobs_outlier, frac_low_f_outlier, frac_high_f_outlier FROM hw) ON frac_low_hobs_outlier, frac_high_hobs_outlier, frac_low_f_outlier, frac_high_f_outlier INTO NAME measure VALUE v) GROUP BY scale, chrom, measure",
    "hobs_subset_summary": _HO + ", m AS (SELECT chrom, median(hobs) AS md FROM ho GROUP BY chrom) SELECT chrom, round(md, 6) AS median, round(1.4826 * median(abs(hobs - md)), 6) AS mad FROM ho JOIN m USING (chrom) GROUP BY chrom, md",
    "hobs_subset_contrast": _HO + ", a AS (SELECT (round_even(pos / 1000.0, 0) * 1000)::BIGINT AS pos_bin, chrom, avg(hobs) AS h, avg(f) AS f FROM ho WHERE chrom IN ('1-URGENT', '5-LOW') GROUP BY 1, 2) SELECT x.pos_bin, round(x.h - y.h, 6) + 0.0 AS delta_hobs, round(x.f - y.f, 6) + 0.0 AS delta_f FROM a x JOIN a y ON x.pos_bin = y.pos_bin AND x.chrom = '1-URGENT' AND y.chrom = '5-LOW'",
    "hobs_binned_pivot": _HO + " SELECT (round_even(pos / 1000.0, 0) * 1000)::BIGINT AS pos_bin, round(avg(hobs) FILTER (chrom = '1-URGENT'), 6) AS urgent, round(avg(hobs) FILTER (chrom = '5-LOW'), 6) AS low FROM ho GROUP BY 1",
    "hobs_groups": ad.with_ctes(ad.SQL_GL) + """, x AS (SELECT chrom, pos, g, avg(h) AS h FROM dos JOIN grp USING (s) GROUP BY chrom, pos, g) SELECT chrom, start, start + 49999 AS "end", g AS "group", round(avg(h), 6) AS hobs, count(*) AS n_sites FROM (SELECT *, unnest(range(greatest(0, (pos - 1 - 49999 + 9999) // 10000), (pos - 1) // 10000 + 1)) * 10000 + 1 AS start FROM x) GROUP BY chrom, start, g""",
}
_HC = ", hc(candidate_id, chrom, start, \"end\") AS (VALUES " + ", ".join(f"('{c[0]}_{k}', '{c}', {k * 4000 + 1}, {k * 4000 + 3000})" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for k in (0, 1, 2)) + ")"
_PERM = """, po AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, stat_name ORDER BY v, inside) AS rw FROM rk),
nd AS (SELECT candidate_id, stat_name, n1, n2, abs(u - n1 * n2 / 2) AS seen FROM u WHERE ok),
dr AS (SELECT po.candidate_id, po.stat_name, rep, n1, n2, seen, rank, row_number() OVER (PARTITION BY po.candidate_id, po.stat_name, rep ORDER BY concat('0x', substr(md5('1|' || po.candidate_id || '|' || po.stat_name || '|' || rep || '|' || rw), 1, 8))::UBIGINT, rw) AS k FROM po JOIN nd USING (candidate_id, stat_name), range(1, 1001) AS r(rep)),
ea AS (SELECT candidate_id, stat_name, rep, seen, abs(sum(rank) - n1 * (n1 + 1) / 2 - n1 * n2 / 2) AS dev FROM dr WHERE k <= n1 GROUP BY candidate_id, stat_name, rep, n1, n2, seen),
pp AS (SELECT candidate_id, stat_name, (count(*) FILTER (dev >= seen) + 1) / 1001.0::DOUBLE AS permutation_p FROM ea GROUP BY candidate_id, stat_name)
SELECT y.*, round(permutation_p, 5) AS permutation_p FROM ("""
_plain = SQL["scan_candidates_vs_flanks"]
_from = _plain.rindex("SELECT candidate_id, stat_name, n1::BIGINT")
SQL["scan_permutation_test"] = _plain[:_from].replace(" UNION ALL SELECT chrom, start, \"end\", 'depth', n_variants::DOUBLE FROM track", "") + _PERM + _plain[_from:] + ") y LEFT JOIN pp USING (candidate_id, stat_name)"
SQL["hobs_overlay"] = _HO + _hw((("1kb", 1_000, 200),), 1.0).replace("6) + 0.0 AS", "15) AS").replace(", 6) AS frac", ", 15) AS frac") + _HC + """, j AS (SELECT c.*, w.start < c."end" AND w."end" > c.start AS ins, (w.start >= c.start - 2000 AND w."end" <= c.start) OR (w.start >= c."end" AND w."end" <= c."end" + 2000) AS fl, w.mean_f, w.median_f, w.frac_high_f_outlier AS hf, w.frac_low_hobs_outlier AS lh FROM hc c LEFT JOIN hw w ON w.chrom = c.chrom),
g AS (SELECT candidate_id, chrom, start, "end", count(*) FILTER (ins) AS n_inside, count(*) FILTER (fl) AS n_flank, avg(mean_f) FILTER (ins) AS mi, avg(median_f) FILTER (ins) AS me, avg(mean_f) FILTER (fl) AS mf, avg(hf) FILTER (ins) AS hf, avg(lh) FILTER (ins) AS lh FROM j GROUP BY ALL)
SELECT candidate_id, chrom, start, "end", n_inside, n_flank, round(mi, 6) + 0.0 AS mean_f_inside, round(me, 6) + 0.0 AS median_f_inside, round(mf, 6) + 0.0 AS mean_f_flank, round(hf, 6) AS frac_high_f, round(lh, 6) AS frac_low_hobs,
 CASE WHEN mi IS NULL OR mf IS NULL THEN 'insufficient_data' WHEN mi - mf > 0.05 AND hf > 0.2 THEN CASE WHEN abs(mi - me) < 0.02 THEN 'broad_localized_distortion' ELSE 'few_extreme_loci' END WHEN lh > 0.3 THEN 'regional_het_deficit' WHEN abs(mi - mf) < 0.02 THEN 'no_signal' ELSE 'weak_signal' END AS pattern FROM g"""
