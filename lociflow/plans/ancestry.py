"""Queries of ancestry, pairs and populations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.expr import sql_erfc
from lociflow.operators import ancestry as an
from lociflow.operators import clusters, pca
from lociflow.operators import relations as rel
from lociflow.operators import homologs as ho
from lociflow.operators import scan
from lociflow.operators.windows import numbered
from lociflow.operators.homologs import likelihood_shares
from lociflow.operators.popstats import dosages
from lociflow.plans import adapters as ad
from lociflow.plans import popstats as pp
from lociflow.plans.dispatch import batch_stats
from lociflow.plans.popstats import rounded
from lociflow.functions import expr
from lociflow.sources import readers, scratch, writers
from lociflow.sources.cache import Cache

LD_REACH = 20_000


def _dos(spark: SparkSession, d: str) -> DataFrame:
    return dosages(ad.gl(spark, d))


def _spread(df: DataFrame, column: str, names: str) -> DataFrame:
    """An array of K numbers as K columns."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[k].alias(f"{names}{k + 1}") for k in range(ad.K)])


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return _spread(likelihood_shares(ad.gl(spark, d)).withColumns(an.q_metrics(F.col("q"))), "q", "q")


def _support(spark: SparkSession, d: str) -> DataFrame:
    return an.q_support(_dos(spark, d), ad.q_matrix(spark))


def _support_windows(spark: SparkSession, d: str) -> DataFrame:
    return an.support_windows(_support(spark, d), 20, 10)


def _site_candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"c{c}_{k}", f"chr{c}", k * 100_000 + 20_000, k * 100_000 + 70_000) for c in range(1, 8) for k in range(3)] + [("far", "chr1", 900_000_000, 900_010_000)], "candidate_id string, chrom string, start long, end long")


def _composition(spark: SparkSession, d: str) -> DataFrame:
    return an.composition(ad.labels(spark, d), ["parent", "sample"], ["ord"], "label", ["delta12"])


def _local_q(spark: SparkSession, d: str) -> DataFrame:
    gl = ad.gl(spark, d)
    return an.local_q(gl, ad.f_matrix(ad.sites(spark, d)), ad.q_matrix(spark), 100, 20)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return rel.introgression_terms(rel.population_frequencies(_dos(spark, d), ad.populations(spark)))


def _ld(spark: SparkSession, d: str) -> DataFrame:
    return rel.ld_pairs(_dos(spark, d), ad.groups(spark), LD_REACH)


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Alleles of sites whose place in thousands is even, and every 500th place of these."""
    s = ad.gl(spark, d).select("chrom", "pos").distinct().withColumn("k", F.floor(F.col("pos") / 1000))
    return s.filter("k % 2 = 0").select("chrom", "pos", F.substring("chrom", -1, 1).alias("major_allele"), F.lit("T").alias("minor_allele")), s.filter("k % 5 = 0").select("chrom", "pos")


def _membership(spark: SparkSession, d: str) -> DataFrame:
    return an.with_membership(_support(spark, d).select("chrom", "pos", "best_q", "marker_class"), *_sets(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Sites with their segment of every candidate of their chromosome."""
    j = ad.gl(spark, d).select("chrom", "pos").distinct().join(F.broadcast(_site_candidates(spark)), "chrom")
    return j.select("candidate_id", expr.segment(F.col("pos"), F.col("start"), F.col("end")).alias("segment")).groupBy("candidate_id", "segment").agg(F.count(F.lit(1)).alias("n_sites"))


def _linkage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples clustered by the sites that they share, for each number of carriers."""
    shared = rel.rare_sharing(_dos(spark, d))
    return clusters.average_linkage(shared, shared.select("bin").distinct().crossJoin(F.broadcast(ad.groups(spark).select("sample_idx"))), ["bin"])


def _beagle(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods written as text and read back."""
    path = scratch.folder(spark, "beagle")
    writers.write_beagle(ad.gl(spark, d), path)
    return readers.beagle(spark, path).select("chrom", "pos", "sample_idx", "gl0", "gl1", "gl2")


def _f_text(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies written as bare rows of numbers, one file a chromosome, read back by line and joined to sites by their place."""
    path = scratch.folder(spark, "frequencies")
    f = ad.f_matrix(ad.gl(spark, d))
    writers.write_matrix(f, path, "pos", "f")
    rows = readers.lines(spark, path).select(F.regexp_extract("_file", "chrom=([^/]+)", 1).alias("chrom"), F.col("line").alias("_i"), F.transform(F.split("value", " "), lambda x: x.cast("double")).alias("f"))
    return _spread(numbered(f.select("chrom", "pos"), ["pos"]).join(rows, ["chrom", "_i"]).select("chrom", "pos", "f"), "f", "f")


def _sharing_text(spark: SparkSession, d: str) -> DataFrame:
    """Sharing written as a matrix of samples for each number of carriers and read back, pairs that share nothing as 0."""
    path = scratch.folder(spark, "sharing")
    writers.write_wide(rel.rare_sharing(_dos(spark, d)), path, "bin", "i", "j", "shared", "0")
    return readers.wide(spark, path, "bin", "i", "j", "shared").select(*[F.col(c).cast("long").alias(c) for c in ("bin", "i", "j", "shared")])


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    return an.residual_dosage(_dos(spark, d), ad.f_matrix(ad.gl(spark, d)), ad.q_matrix(spark)).withColumn("residual", F.round("residual", 6) + F.lit(0.0))


def _residual_text(spark: SparkSession, d: str) -> DataFrame:
    """Residual dosages written as a packed matrix of sites by samples for each chromosome and read back."""
    path = scratch.folder(spark, "residuals")
    writers.write_wide(_residuals(spark, d), path, "chrom", "pos", "sample_idx", "residual", compression="gzip")
    got = readers.wide(spark, path, "chrom", "pos", "sample_idx", "residual")
    return got.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("sample_idx").cast("int").alias("sample_idx"), expr.number(F.col("residual")).alias("residual")).filter("residual is not null")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """Support of sites asked for twice: first for three chromosomes, then for all, of which the cache computes the others alone."""
    cache = Cache(spark, scratch.folder(spark, "kept"))
    rows = _support(spark, d).select("chrom", "pos", "best_q", F.round("best", 6).alias("best"))
    chroms = [f"chr{c}" for c in range(1, 8)]
    compute = lambda own: rows.filter(F.col("chrom").isin(own))
    cache.get(ad.K, "all", chroms[:3], compute)
    return cache.get(ad.K, "all", chroms, compute)


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """A table of regions whose later version replaces rows by key and has a column more."""
    path = scratch.folder(spark, "upsert")
    sites = ad.gl(spark, d).groupBy("chrom", (F.floor(F.col("pos") / 100_000) * 100_000).alias("start")).agg(F.countDistinct("pos").alias("n_sites"))
    sites.write.parquet(path)
    new = sites.filter("start >= 100000").select("chrom", "start", (F.col("n_sites") * 2).alias("n_sites"), F.lit("second").alias("round"))
    return writers.upsert(spark.read.parquet(path), new, ["chrom", "start"])


def _merged_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Sharing of each chromosome by itself, and their sum."""
    dos = _dos(spark, d)
    return rel.merged_sharing([rel.rare_sharing(dos.filter(F.col("chrom") == f"chr{c}")) for c in range(1, 8)])


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Samples grouped by bands of their mean dosage, by karyotypes of a chromosome's windows, and by their likeliest genotype."""
    gl = ad.gl(spark, d)
    name = F.col("sample_idx").cast("string").alias("sample_id")
    values = _dos(spark, d).groupBy("chrom", "sample_idx").agg(F.round(F.avg("dosage"), 9).alias("value")).select("chrom", name, "value")
    classes = ho.karyotypes(gl, 200_000).select("chrom", F.concat_ws("_", F.lit("inv"), "chrom", F.col("start").cast("string"), "group").alias("class"), name)
    g = ho.Groups(spark, spark.createDataFrame([], "group string, sample_id string"), values=values, classes=classes, q=likelihood_shares(gl).select(name, "q"))
    out = g.resolve("ancestry_clusters").withColumn("strategy", F.lit("ancestry_clusters")).withColumn("chrom", F.lit("all"))
    for c in range(1, 8):
        for s in ("precomp_bands", "C01i_decomposition"):
            out = out.unionByName(g.resolve(s, f"chr{c}").withColumn("strategy", F.lit(s)).withColumn("chrom", F.lit(f"chr{c}")))
    return out


def _track_text(spark: SparkSession, d: str) -> DataFrame:
    """The track written as text and read back, columns found by their names."""
    path = scratch.folder(spark, "track")
    writers.write_track(ad.track(spark, d).withColumnRenamed("stat", "fst"), path, text=True)
    return readers.track(spark, path)


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Support of sites in the cache of results, written twice, read for one chromosome."""
    path = scratch.folder(spark, "cache")
    rows = _support(spark, d).select("chrom", "pos", "best_q", "marker_class")
    writers.write_cache(rows, path, ad.K, "all")
    writers.write_cache(rows.filter("chrom = 'chr2'"), path, ad.K, "all")
    return readers_cache(spark, path)


def readers_cache(spark: SparkSession, path: str) -> DataFrame:
    return writers.read_cache(spark, path, ad.K, "all").select("chrom", "pos", "best_q", "marker_class")


QUERIES = {
    "pop_batch_candidates": lambda s, d: rounded(batch_stats(ad.gl(s, d), _site_candidates(s), F.broadcast(ad.groups(s)))),
    "anc_membership": _membership,
    "anc_segments": _segments,
    "rel_sample_pc1": lambda s, d: rounded(pca.first_component(_dos(s, d)), 4),
    "rel_local_pca": lambda s, d: rounded(pca.local_pca(_dos(s, d), 100_000, 50_000), 4),
    "rel_sharing_clusters": lambda s, d: rounded(_linkage(s, d)[0]),
    "rel_sharing_order": lambda s, d: _linkage(s, d)[1],
    "anc_class_order": lambda s, d: rounded(clusters.class_order(_composition(s, d), "sample", "structure_class", "mean_delta12")),
    "rel_rare_sharing_log": lambda s, d: rel.rare_sharing(_dos(s, d)).select("bin", "i", "j", F.round(expr.log10_1p(F.col("shared")), 6).alias("log_shared")),
    "io_beagle": _beagle,
    "io_track_text": _track_text,
    "io_cache": _cache,
    "io_cache_twice": _kept,
    "io_upsert": _upserted,
    "io_sharing_matrix": _sharing_text,
    "io_residual_matrix": _residual_text,
    "io_f_matrix": lambda s, d: rounded(_f_text(s, d)),
    "rel_sharing_merged": _merged_sharing,
    "groups_strategies": _groups,
    "anc_q_metrics": lambda s, d: rounded(_metrics(s, d)),
    "anc_residual_dosage": _residuals,
    "anc_q_support": lambda s, d: rounded(_spread(_support(s, d), "support", "support_q")),
    "anc_support_windows": lambda s, d: rounded(_spread(_support_windows(s, d), "mean_support", "mean_support_q")),
    "anc_candidate_support": lambda s, d: rounded(an.candidate_support(_site_candidates(s), _support_windows(s, d))),
    "anc_label_runs": lambda s, d: an.runs(ad.labels(s, d), ["sample"], ["ord"], "label"),
    "anc_composition": lambda s, d: _composition(s, d),
    "anc_parent_summary": lambda s, d: an.parent_summary(_composition(s, d)),
    "anc_modal_label": lambda s, d: an.modal_label(ad.labels(s, d), ["sample"], "label"),
    "anc_local_q": lambda s, d: rounded(_spread(_local_q(s, d), "q", "q")),
    "anc_local_q_summary": lambda s, d: rounded(an.local_q_summary(_local_q(s, d))),
    "anc_best_k": lambda s, d: rounded(an.best_k(ad.table(s, d, "embeddings").select(F.col("label").alias("K"), (-F.abs(F.col("embedding")[0].cast("double"))).alias("loglik")))),
    "rel_rare_sharing": lambda s, d: rel.rare_sharing(_dos(s, d)),
    "rel_group_sharing": lambda s, d: rel.group_sharing(rel.rare_sharing(_dos(s, d)), ad.groups(s)),
    "rel_ld_pairs": lambda s, d: rounded(_ld(s, d), 5),
    "rel_ld_decomposition": lambda s, d: rounded(rel.ld_decomposition(_ld(s, d)), 5),
    "rel_ld_blocks": lambda s, d: rounded(rel.ld_blocks(_ld(s, d), span=rel.ld_span(ad.sites(s, d), LD_REACH)), 5),
    "rel_introgression": lambda s, d: rounded(rel.introgression(_terms(s, d), 50_000, 10_000)),
    "rel_introgression_jackknife": lambda s, d: rounded(scan.jackknife(rel.site_blocks(_terms(s, d), 20), "num", "den"), 5),
    "rel_xp_ehh": lambda s, d: rounded(scan.z_scores(rel.xp_ehh(ad.gl(s, d), [0, 1, 2, 3], [6, 7, 8, 9], smallest=4), "raw"), 5),
    "rel_ihs": lambda s, d: rounded(scan.z_scores(rel.ihs(ad.gl(s, d), smallest=2).withColumn("bin", rel.frequency_bin(F.col("freq"))), "raw", ["bin"]), 5),
    "rel_ehh_windows": lambda s, d: rounded(rel.ehh_windows(scan.z_scores(rel.xp_ehh(ad.gl(s, d), [0, 1, 2, 3], [6, 7, 8, 9], smallest=4), "raw"), 50_000, 10_000, "raw_norm"), 5),
}

_G = ad.with_ctes(ad.SQL_GL, ad.SQL_Q)
_MET = "{m} AS max_q, list_sort({q}, 'DESC')[1] - list_sort({q}, 'DESC')[2] AS delta12"
_ENT = "-list_sum([greatest(x, 1e-10) * ln(greatest(x, 1e-10)) FOR x IN {q}])"
_SUP = f""", kn AS (SELECT chrom, pos, count(*) AS n, avg(d) AS m, stddev_pop(d) AS sd FROM dos GROUP BY chrom, pos),
co AS (SELECT chrom, pos, k, abs(corr(d, x)) AS r FROM dos JOIN qm USING (s) GROUP BY chrom, pos, k),
sp AS (SELECT chrom, pos, list(r ORDER BY k) AS raw, sum(r) AS t FROM co GROUP BY chrom, pos), s2 AS (SELECT chrom, pos, m, [CASE WHEN t > 1e-10 THEN x / t ELSE 1.0 / 3 END FOR x IN raw] AS q FROM sp JOIN kn USING (chrom, pos) WHERE sd > 1e-10),
sup AS (SELECT chrom, pos, q, list_position(q, list_max(q))::INT AS best_q, list_max(q) AS best, list_sort(q, 'DESC')[1] - list_sort(q, 'DESC')[2] AS delta12, list_sort(q, 'DESC')[1] - list_sort(q, 'DESC')[3] AS delta13, {_ENT.format(q="q")} AS entropy, least(m / 2, 1 - m / 2) AS maf FROM s2)"""
_SW = """, nu AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM sup),
wi AS (SELECT *, unnest(range(greatest(0, (i - 19 + 9) // 10), least(greatest(0, (n - 20) // 10), i // 10) + 1)) + 1 AS window_id FROM nu),
ws AS (SELECT *, (best_q <> lag(best_q) OVER (PARTITION BY chrom, window_id ORDER BY pos))::INT AS sw FROM wi),
wt AS (SELECT chrom, window_id, max(c) AS c FROM (SELECT chrom, window_id, best_q, count(*) AS c FROM wi GROUP BY ALL) GROUP BY ALL),
wb AS (SELECT chrom, window_id, min(pos) AS start, max(pos) AS "end", count(*) AS n_snps, avg(entropy) AS mean_entropy, coalesce(sum(sw), 0)::BIGINT AS switches, [avg(q[1]), avg(q[2]), avg(q[3])] AS ms FROM ws GROUP BY chrom, window_id),
sw AS (SELECT wb.*, list_position(ms, list_max(ms))::INT AS dominant_q, list_max(ms) AS dominant_share, c / n_snps AS coherence, c / n_snps < 0.5 AS mixed FROM wb JOIN wt USING (chrom, window_id))"""
_SC = ", cand(candidate_id, chrom, start, \"end\") AS (VALUES " + ", ".join(f"('c{c}_{k}', 'chr{c}', {k * 100_000 + 20_000}, {k * 100_000 + 70_000})" for c in range(1, 8) for k in range(3)) + ", ('far', 'chr1', 900000000, 900010000))"
_L = ad.with_ctes(ad.SQL_LABELS)
_RUN = ", rn AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY sample ORDER BY i) THEN 0 ELSE 1 END AS nw FROM lab), rb AS (SELECT *, sum(nw) OVER (PARTITION BY sample ORDER BY i)::BIGINT AS block FROM rn), runs AS (SELECT parent, sample, block, label, count(*) AS length FROM rb GROUP BY ALL)"
_COMP = _RUN + """, ba AS (SELECT parent, sample, count(*) AS n, round(avg(delta12), 4) AS mean_delta12 FROM lab GROUP BY ALL HAVING count(*) >= 3),
cn AS (SELECT sample, label, count(*) AS c FROM lab GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY c DESC, label) AS k FROM cn),
cs AS (SELECT sample, count(*) AS n_labels, max(label) FILTER (k = 1) AS dominant, max(c) FILTER (k = 1) AS c1, coalesce(max(c) FILTER (k = 2), 0) AS c2, sum(-(c / n) * ln(c / n)) AS le FROM rk JOIN ba USING (sample) GROUP BY sample),
bl AS (SELECT sample, count(*) AS nb, list_sort(list(length), 'DESC') AS b FROM runs GROUP BY sample),
hf AS (SELECT sample, CASE WHEN i <= count(*) OVER (PARTITION BY sample) // 2 THEN 0 ELSE 1 END AS h, label FROM lab), hm AS (SELECT sample, h, label, row_number() OVER (PARTITION BY sample, h ORDER BY count(*) DESC, label) AS k FROM hf GROUP BY sample, h, label),
hd AS (SELECT sample, max(label) FILTER (h = 0) <> max(label) FILTER (h = 1) AS differ FROM hm WHERE k = 1 GROUP BY sample),
comp AS (SELECT parent, ba.sample, n AS n_windows, n_labels, dominant, round(c1 / n, 4) AS dominant_share, round(c2 / n, 4) AS second_share, nb AS n_blocks, nb - 1 AS switches, b[1] AS largest_block, coalesce(b[2], 0) AS second_block, round((nb - 1) / greatest(1, n - 1), 4) AS fragmentation, round(le, 4) AS label_entropy, mean_delta12,
 CASE WHEN n < 3 THEN 'too_sparse' WHEN n_labels = 1 THEN 'homogeneous' WHEN c1 / n >= 0.8 AND nb - 1 <= 2 THEN 'dominant_plus_secondary' WHEN n_labels = 2 AND c1 / n BETWEEN 0.3 AND 0.7 THEN 'two_block_composite' WHEN nb - 1 >= 0.4 * n THEN 'multi_block_fragmented' WHEN nb - 1 <= 2 AND n_labels <= 3 THEN CASE WHEN differ THEN 'continuous_gradient' ELSE 'dominant_plus_secondary' END ELSE 'diffuse_mixed' END AS structure_class FROM ba JOIN cs USING (sample) JOIN bl USING (sample) JOIN hd USING (sample))"""
_RARE = ", ca AS (SELECT chrom, pos, s FROM dos WHERE d >= 0.5), mc AS (SELECT chrom, pos, count(*) AS bin FROM ca GROUP BY ALL HAVING count(*) IN (2, 3, 4, 5)), sh AS (SELECT bin, a.s AS i, b.s AS j, count(*) AS shared FROM mc JOIN ca a USING (chrom, pos) JOIN ca b USING (chrom, pos) GROUP BY ALL)"
_LD = ", gd AS (SELECT chrom, pos, g, s, d FROM dos JOIN grp USING (s)), ld AS (SELECT a.chrom, a.g AS \"group\", a.pos AS pos_a, b.pos AS pos_b, CASE WHEN var_pop(a.d) * count(*) > 1e-12 AND var_pop(b.d) * count(*) > 1e-12 THEN corr(a.d, b.d) * corr(a.d, b.d) ELSE 0 END AS r2 FROM gd a JOIN gd b ON a.chrom = b.chrom AND a.g = b.g AND a.s = b.s AND b.pos > a.pos AND b.pos - a.pos <= 20000 GROUP BY ALL)"
_INT = """, pf AS (SELECT chrom, pos, avg(d) FILTER (g = 'P1') / 2 AS p1, avg(d) FILTER (g = 'P2') / 2 AS p2, avg(d) FILTER (g = 'P3') / 2 AS p3, avg(d) FILTER (g = 'O') / 2 AS po FROM dos JOIN pops USING (s) GROUP BY chrom, pos),
tm AS (SELECT chrom, pos, (1-p1)*p2*p3*(1-po) AS abba, p1*(1-p2)*p3*(1-po) AS baba, p3*(1-po)*(p2-p1) AS num, greatest(0, CASE WHEN p2 >= p1 THEN greatest(p2,p3)*(1-po)*(greatest(p2,p3)-p1) ELSE greatest(p1,p3)*(1-po)*(greatest(p1,p3)-p2) END) AS den FROM pf)"""
SQL = {
    "anc_q_metrics": ad.with_ctes(ad.SQL_GL, ad.SQL_SHARES) + f" SELECT s AS sample_idx, round(list_max(q), 6) AS max_q, round(list_sort(q, 'DESC')[1] - list_sort(q, 'DESC')[2], 6) AS delta12, round({_ENT.format(q='q')}, 6) AS entropy, round(exp({_ENT.format(q='q')}), 6) AS ena, list_position(q, list_max(q))::INT AS assigned_pop, len([x FOR x IN q IF x > 0.05])::INT AS n_above_005, len([x FOR x IN q IF x > 0.1])::INT AS n_above_010, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3 FROM ql",
    "anc_residual_dosage": ad.with_ctes(ad.SQL_GL, ad.SQL_Q, ad.SQL_F) + ", mx AS (SELECT chrom, pos, s, list_reduce(list(x * f ORDER BY k), lambda a, b: a + b) AS m FROM fm JOIN qm USING (k) GROUP BY ALL) SELECT chrom, pos, s AS sample_idx, d AS dosage, round(d - 2 * m, 6) + 0.0 AS residual FROM dos JOIN mx USING (chrom, pos, s)",
    "anc_q_support": _G + _SUP + " SELECT chrom, pos, best_q, round(best, 6) AS best, round(delta12, 6) AS delta12, round(delta13, 6) AS delta13, round(entropy, 6) AS entropy, round(exp(entropy), 6) AS ena, round(maf, 6) AS maf, CASE WHEN best >= 0.5 AND delta12 >= 0.2 THEN 'dominant_single_Q' WHEN best >= 0.5 THEN 'dominant_plus_secondary' WHEN best >= 0.3 THEN 'mixed_Q_support' WHEN entropy > 1.5 THEN 'diffuse' ELSE 'low_information' END AS marker_class, CASE WHEN best >= 0.5 THEN 'high' WHEN best >= 0.3 THEN 'moderate' ELSE 'low' END AS confidence, round(q[1], 6) AS support_q1, round(q[2], 6) AS support_q2, round(q[3], 6) AS support_q3 FROM sup",
    "anc_support_windows": _G + _SUP + _SW + ' SELECT chrom, window_id, start, "end", n_snps, round(mean_entropy, 6) AS mean_entropy, switches, dominant_q, round(dominant_share, 6) AS dominant_share, round(coherence, 6) AS coherence, mixed, round(ms[1], 6) AS mean_support_q1, round(ms[2], 6) AS mean_support_q2, round(ms[3], 6) AS mean_support_q3 FROM sw',
    "anc_candidate_support": _G + _SUP + _SW + _SC + """, j AS (SELECT candidate_id, w.*, row_number() OVER (PARTITION BY candidate_id ORDER BY w.start, w."end") AS o FROM cand c JOIN sw w ON w.chrom = c.chrom AND c.start < w."end" AND c."end" > w.start),
js AS (SELECT *, (dominant_q <> lag(dominant_q) OVER (PARTITION BY candidate_id ORDER BY o))::INT AS s1 FROM j), tp AS (SELECT candidate_id, dominant_q, row_number() OVER (PARTITION BY candidate_id ORDER BY c DESC, dominant_q) AS k FROM (SELECT candidate_id, dominant_q, count(*) AS c FROM j GROUP BY ALL)),
g AS (SELECT candidate_id, count(*) AS n_windows, avg(dominant_share) AS md, avg(mixed::INT) AS mx, avg(mean_entropy) AS me, avg(coherence) AS mc, coalesce(sum(s1), 0)::BIGINT AS switches FROM js GROUP BY candidate_id)
SELECT c.candidate_id, c.chrom, c.start, c."end", n_windows, round(md, 6) AS mean_dominant, round(mx, 6) AS mixed_share, round(me, 6) AS mean_entropy, round(mc, 6) AS mean_coherence, switches, tp.dominant_q, CASE WHEN n_windows IS NOT NULL THEN CASE WHEN mc >= 0.7 AND md >= 0.4 THEN 'yes' ELSE 'no' END END AS coherent_core, CASE WHEN n_windows IS NOT NULL THEN CASE WHEN mx > 0.5 THEN 'yes' ELSE 'no' END END AS mixed_background, CASE WHEN n_windows IS NOT NULL THEN CASE WHEN switches > 0.3 * n_windows AND mx > 0.3 THEN 'yes' ELSE 'no' END END AS parasite, CASE WHEN n_windows IS NULL THEN 'no_data' WHEN md > 0.5 AND mx < 0.5 THEN 'likely_ancestry' ELSE 'unclassified' END AS ancestry_class FROM cand c LEFT JOIN g USING (candidate_id) LEFT JOIN tp ON tp.candidate_id = c.candidate_id AND tp.k = 1""",
    "anc_label_runs": _L + _RUN + " SELECT sample, block, label, length FROM runs",
    "anc_composition": _L + _COMP + " SELECT * FROM comp",
    "anc_parent_summary": _L + _COMP + ", pc AS (SELECT parent, structure_class AS k, count(*) AS c FROM comp GROUP BY ALL), pr AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY c DESC, k) AS o FROM pc) SELECT parent, count(*) AS n_samples, (SELECT string_agg(k || ':' || c, '; ' ORDER BY k) FROM pc WHERE pc.parent = comp.parent) AS classes, (SELECT k FROM pr WHERE pr.parent = comp.parent AND o = 1) AS top_class, (SELECT c FROM pr WHERE pr.parent = comp.parent AND o = 1) AS top_count, round(avg(fragmentation), 4) AS mean_fragmentation, round(avg(switches), 4) AS mean_switches FROM comp GROUP BY parent",
    "anc_modal_label": _L + ", c0 AS (SELECT sample, label, count(*) AS c FROM lab GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY c DESC, label) AS k FROM c0) SELECT sample, label AS modal, c AS count FROM c WHERE k = 1",
    "anc_best_k": "SELECT label AS K, round(-abs(embedding[1]::DOUBLE), 6) AS loglik FROM embeddings ORDER BY abs(embedding[1]::DOUBLE), label LIMIT 1",
    "rel_rare_sharing": ad.with_ctes(ad.SQL_GL) + _RARE + " SELECT * FROM sh",
    "rel_group_sharing": ad.with_ctes(ad.SQL_GL) + _RARE + ", pr AS (SELECT a.g AS group_a, b.g AS group_b, count(*) FILTER (a.s <> b.s) AS pairs FROM grp a, grp b GROUP BY ALL), sg AS (SELECT bin, a.g AS group_a, b.g AS group_b, sum(shared) AS x FROM sh JOIN grp a ON a.s = i JOIN grp b ON b.s = j WHERE i <> j GROUP BY ALL) SELECT bin, group_a, group_b, pairs, round(CASE WHEN pairs > 0 THEN coalesce(x, 0) / pairs ELSE 0 END, 2) AS mean_shared FROM (SELECT * FROM (SELECT DISTINCT bin FROM sh) b0, pr) q LEFT JOIN sg USING (bin, group_a, group_b)",
    "rel_ld_pairs": ad.with_ctes(ad.SQL_GL) + _LD + ' SELECT chrom, "group", pos_a, pos_b, round(r2, 5) AS r2 FROM ld',
    "rel_ld_decomposition": ad.with_ctes(ad.SQL_GL) + _LD + ', t AS (SELECT chrom, pos_a, pos_b, sum(r2) AS t, max(r2) AS m, -sum(CASE WHEN r2 > 0 THEN r2 * log2(r2) ELSE 0 END) AS e FROM ld GROUP BY ALL) SELECT chrom, pos_a, pos_b, (SELECT min("group") FROM ld WHERE ld.chrom = t.chrom AND ld.pos_a = t.pos_a AND ld.pos_b = t.pos_b AND ld.r2 = m) AS dominant_group, round(CASE WHEN t > 0 THEN m / t ELSE 0 END, 5) AS purity, round(CASE WHEN t > 0 THEN e / t + log2(t) ELSE 0 END, 5) + 0.0 AS entropy FROM t',
    "rel_ld_blocks": ad.with_ctes(ad.SQL_GL) + _LD + ', sn AS (SELECT chrom, min(pos_a) AS lo, max(pos_b) AS hi FROM ld GROUP BY chrom), b AS (SELECT ld.*, least(7, floor((pos_a - lo) * 8 / (hi - lo + 1)))::BIGINT AS ba, least(7, floor((pos_b - lo) * 8 / (hi - lo + 1)))::BIGINT AS bb FROM ld JOIN sn USING (chrom)) SELECT chrom, ba AS block, "group", count(*) AS n_pairs, round(avg(r2), 5) AS mean_r2 FROM b WHERE ba = bb GROUP BY ALL',
    "rel_introgression": ad.with_ctes(ad.SQL_GL) + _INT + ", w AS (SELECT chrom, start, count(*) AS n_sites, count(*) FILTER (abs(num) > 1e-15) AS n_informative, sum(abba) AS a, sum(baba) AS b, sum(num) AS num, sum(den) AS den FROM (SELECT *, unnest(range(greatest(0, (pos - 49999 + 9999) // 10000), pos // 10000 + 1)) * 10000 AS start FROM tm) GROUP BY chrom, start) SELECT chrom, start, start + 49999 AS \"end\", n_sites, n_informative, CASE WHEN a + b > 1e-15 THEN round((a - b) / (a + b), 6) + 0.0 END AS D, CASE WHEN den > 1e-15 THEN round(num / den, 6) + 0.0 END AS fdM FROM w",
    "rel_introgression_jackknife": ad.with_ctes(ad.SQL_GL) + _INT + f", ix AS (SELECT *, row_number() OVER (ORDER BY chrom, pos) - 1 AS i, count(*) OVER () AS n FROM tm), bk AS (SELECT least(i // greatest(1, n // 20), 19) AS block, sum(num) AS num, sum(den) AS den FROM ix GROUP BY 1), tt AS (SELECT sum(num) AS n, sum(den) AS d, count(*) AS b FROM bk), jk AS (SELECT b, tt.n / tt.d AS est, sqrt((b - 1) * var_pop((tt.n - num) / (tt.d - den))) AS se FROM bk, tt GROUP BY b, tt.n, tt.d) SELECT b AS n_blocks, round(est, 5) AS estimate, round(se, 5) AS se, round(est / se, 5) AS z, round({sql_erfc('abs(est / se) / sqrt(2.0::double)')}, 5) AS p FROM jk",
}
_IN = _SC + """, dc AS (SELECT candidate_id AS chrom, pos, s, d, h FROM dos JOIN cand USING (chrom) WHERE pos BETWEEN start AND "end")"""
_B = lambda t: t.replace("FROM dos", "FROM dc").replace("JOIN dos", "JOIN dc")
_ONE = pp._COHORT.replace(pp._WIN + " AS start", "0 AS start")
SQL |= {
    "pop_batch_candidates": ad.with_ctes(ad.SQL_GL) + _IN + ", " + _B(pp._SITE) + ", " + _ONE + ", " + _B(pp._FREQ) + """, pr AS (SELECT a.chrom, a.g AS ga, b.g AS gb, count(*) AS n, sum((a.p-b.p)*(a.p-b.p) - a.p*(1-a.p)/(a.n-1) - b.p*(1-b.p)/(b.n-1)) AS num, sum(a.p*(1-b.p) + b.p*(1-a.p)) AS den FROM freq a JOIN freq b ON a.chrom = b.chrom AND a.pos = b.pos AND a.g < b.g GROUP BY ALL),
fl AS (SELECT chrom, """ + ", ".join(f"max(CASE WHEN n >= 5 THEN {v} ELSE 0 END) FILTER (ga = '{a}' AND gb = '{b}') AS {n}_{a}_{b}" for n, v in (("Fst", "CASE WHEN den > 1e-15 THEN greatest(0, num / den) ELSE 0 END"), ("dXY", "den / n")) for a, b in (("HET", "HOM_A"), ("HET", "HOM_B"), ("HOM_A", "HOM_B"))) + """ FROM pr GROUP BY chrom), hb AS (SELECT chrom, avg(h) AS hobs FROM dc GROUP BY chrom)
SELECT candidate_id, n_sites, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("theta_pi", "theta_W", "Tajima_D", "Hp")) + ", round(hobs, 6) AS Hobs, " + ", ".join(f"round({n}_{p}, 6) AS {n}_{p}" for n in ("Fst", "dXY") for p in ("HET_HOM_A", "HET_HOM_B", "HOM_A_HOM_B")) + ", CASE WHEN n_sites IS NOT NULL THEN round(coalesce(Fst_HOM_A_HOM_B, 0), 6) END AS arrangement_FST_like FROM cand LEFT JOIN coh ON coh.chrom = candidate_id LEFT JOIN hb ON hb.chrom = candidate_id LEFT JOIN fl ON fl.chrom = candidate_id",
    "anc_membership": _G + _SUP + " SELECT chrom, pos, best_q, CASE WHEN best >= 0.5 AND delta12 >= 0.2 THEN 'dominant_single_Q' WHEN best >= 0.5 THEN 'dominant_plus_secondary' WHEN best >= 0.3 THEN 'mixed_Q_support' WHEN entropy > 1.5 THEN 'diffuse' ELSE 'low_information' END AS marker_class, CASE WHEN pos // 1000 % 2 = 0 THEN right(chrom, 1) ELSE '' END AS major_allele, CASE WHEN pos // 1000 % 2 = 0 THEN 'T' ELSE '' END AS minor_allele, CASE WHEN pos // 1000 % 2 = 0 THEN 'yes' ELSE 'no' END AS in_majmin, CASE WHEN pos // 1000 % 5 = 0 THEN 'yes' ELSE 'no' END AS in_thin500 FROM sup",
    "anc_segments": ad.with_ctes(ad.SQL_GL) + _SC + """ SELECT candidate_id, CASE WHEN pos < start THEN 'Left flank' WHEN pos < (start + "end") / 2 THEN 'Inv. left half' WHEN pos <= "end" THEN 'Core' WHEN pos <= "end" + ("end" - start) * 0.5 THEN 'Inv. right half' ELSE 'Right flank' END AS segment, count(*) AS n_sites FROM (SELECT DISTINCT chrom, pos FROM gl) JOIN cand USING (chrom) GROUP BY ALL""",
    "rel_sample_pc1": ad.with_ctes(ad.SQL_GL).replace("WITH ", "WITH RECURSIVE ", 1) + """, ce AS (SELECT chrom, pos, s, d - avg(d) OVER (PARTITION BY chrom, pos) AS x FROM dos), cv AS (SELECT a.s AS i, b.s AS j, avg(a.x * b.x) AS c FROM ce a JOIN ce b USING (chrom, pos) GROUP BY ALL),
cr AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i), mt AS (SELECT list(r ORDER BY i) AS m, list(i ORDER BY i) AS ids, count(*) AS n FROM cr),
it AS (SELECT 0 AS k, [z::DOUBLE FOR z IN range(1, n + 1)] AS v FROM mt UNION ALL SELECT k + 1, [z / sqrt(list_sum([y * y FOR y IN w])) FOR z IN w] FROM (SELECT k, [list_sum([r[q] * v[q] FOR q IN range(1, n + 1)]) FOR r IN m] AS w FROM it, mt WHERE k < 100)),
pc AS (SELECT unnest(ids) AS sample_idx, unnest(v) AS pc1 FROM it, mt WHERE k = 100) SELECT sample_idx, round(pc1, 4) + 0.0 AS pc1, (row_number() OVER (ORDER BY pc1, sample_idx) - 1)::INT AS place FROM pc""",
    "rel_rare_sharing_log": ad.with_ctes(ad.SQL_GL) + _RARE + " SELECT bin, i, j, round(log10(shared + 1), 6) AS log_shared FROM sh",
    "io_beagle": ad.with_ctes(ad.SQL_GL) + " SELECT chrom, pos, s AS sample_idx, gl0, gl1, gl2 FROM gl",
    "io_track_text": ad.with_ctes(ad.SQL_TRACK) + " SELECT chrom, start, \"end\", stat, n_variants FROM track",
    "io_cache": _G + _SUP + " SELECT chrom, pos, best_q, CASE WHEN best >= 0.5 AND delta12 >= 0.2 THEN 'dominant_single_Q' WHEN best >= 0.5 THEN 'dominant_plus_secondary' WHEN best >= 0.3 THEN 'mixed_Q_support' WHEN entropy > 1.5 THEN 'diffuse' ELSE 'low_information' END AS marker_class FROM sup",
}
_ITER = """ AS (SELECT chrom, cell, 0 AS k, [z::DOUBLE FOR z IN range(1, n + 1)] AS v FROM mt UNION ALL SELECT chrom, cell, k + 1, [z / greatest(sqrt(list_sum([y * y FOR y IN w])), 1e-300) FOR z IN w] FROM (SELECT chrom, cell, k, {free} AS w FROM (SELECT i.chrom, i.cell, k, {u}[list_sum([r[q] * i.v[q] FOR q IN range(1, n + 1)]) FOR r IN m] AS w FROM {it} i JOIN mt USING (chrom, cell){join} WHERE k < 100)))"""
SQL["rel_local_pca"] = ad.with_ctes(ad.SQL_GL).replace("WITH ", "WITH RECURSIVE ", 1) + """, ce AS (SELECT chrom, pos, unnest(range(greatest(0, pos // 50000 - 1), pos // 50000 + 1)) AS cell, s, d - avg(d) OVER (PARTITION BY chrom, pos) AS x FROM dos),
cv AS (SELECT chrom, a.cell, a.s AS i, b.s AS j, sum(a.x * b.x) AS c, count(*) AS ns FROM ce a JOIN ce b USING (chrom, pos, cell) GROUP BY ALL), cr AS (SELECT chrom, cell, i, max(ns) AS ns, list(c ORDER BY j) AS r FROM cv GROUP BY chrom, cell, i),
mt AS (SELECT chrom, cell, max(ns) AS n_sites, list(r ORDER BY i) AS m, list(i ORDER BY i) AS ids, count(*) AS n FROM cr GROUP BY chrom, cell),
i1""" + _ITER.format(free="w", u="", it="i1", join="") + ", p1 AS (SELECT chrom, cell, v AS u FROM i1 WHERE k = 100), i2" + _ITER.format(free="[w[q] - list_sum([u[z] * w[z] FOR z IN range(1, len(w) + 1)]) * u[q] FOR q IN range(1, len(w) + 1)]", u="u, ", it="i2", join=" JOIN p1 USING (chrom, cell)") + """,
pc AS (SELECT chrom, cell, 1 AS j, u AS v FROM p1 UNION ALL SELECT chrom, cell, 2, v FROM i2 WHERE k = 100),
sc AS (SELECT chrom, cell, n_sites, j, ids, v, CASE WHEN list_max(v) >= -list_min(v) THEN 1.0 ELSE -1.0 END * sqrt(greatest(0, list_sum([v[q] * list_sum([m[q][z] * v[z] FOR z IN range(1, n + 1)]) FOR q IN range(1, n + 1)]))) AS f FROM pc JOIN mt USING (chrom, cell)),
ex AS (SELECT chrom, cell, n_sites, j, f, unnest(ids) AS s, unnest(v) AS x FROM sc)
SELECT chrom, cell * 50000 AS start, cell * 50000 + 99999 AS "end", n_sites, s AS sample_idx, round(max(x * f) FILTER (j = 1), 4) + 0.0 AS pc1, round(max(x * f) FILTER (j = 2), 4) + 0.0 AS pc2 FROM ex GROUP BY chrom, cell, n_sites, s"""
SQL["anc_class_order"] = _L + _COMP + " SELECT sample, structure_class, round(mean_delta12, 6) AS mean, (row_number() OVER (ORDER BY structure_class, mean_delta12, sample) - 1)::INT AS place FROM comp"
SQL |= {
    "io_cache_twice": _G + _SUP + " SELECT chrom, pos, best_q, round(best, 6) AS best, CASE WHEN chrom IN ('chr1', 'chr2', 'chr3') THEN 1 ELSE 2 END AS since FROM sup",
    "io_upsert": ad.with_ctes(ad.SQL_GL) + " SELECT chrom, pos // 100000 * 100000 AS start, count(DISTINCT pos) * CASE WHEN pos // 100000 >= 1 THEN 2 ELSE 1 END AS n_sites, CASE WHEN pos // 100000 >= 1 THEN 'second' END AS round FROM gl GROUP BY chrom, pos // 100000",
    "io_sharing_matrix": ad.with_ctes(ad.SQL_GL) + _RARE + " SELECT r.bin::BIGINT AS bin, r.i::BIGINT AS i, n.j::BIGINT AS j, coalesce(shared, 0)::BIGINT AS shared FROM (SELECT DISTINCT bin, i FROM sh) AS r CROSS JOIN (SELECT DISTINCT j FROM sh) AS n LEFT JOIN sh ON sh.bin = r.bin AND sh.i = r.i AND sh.j = n.j",
    "io_residual_matrix": ad.with_ctes(ad.SQL_GL, ad.SQL_Q, ad.SQL_F) + ", mx AS (SELECT chrom, pos, s, list_reduce(list(x * f ORDER BY k), lambda a, b: a + b) AS m FROM fm JOIN qm USING (k) GROUP BY ALL) SELECT chrom, pos, s AS sample_idx, round(d - 2 * m, 6) + 0.0 AS residual FROM dos JOIN mx USING (chrom, pos, s)",
    "io_f_matrix": ad.with_ctes(ad.SQL_GL, ad.SQL_F) + " SELECT chrom, pos, round(max(f) FILTER (k = 0), 6) AS f1, round(max(f) FILTER (k = 1), 6) AS f2, round(max(f) FILTER (k = 2), 6) AS f3 FROM fm GROUP BY chrom, pos",
    "rel_sharing_merged": ad.with_ctes(ad.SQL_GL) + _RARE + " SELECT * FROM sh",
    "groups_strategies": ad.with_ctes(ad.SQL_GL, ad.SQL_SHARES) + """, mv AS (SELECT chrom, s::VARCHAR AS sample_id, round(avg(d), 9) AS value FROM dos GROUP BY ALL), gp AS (SELECT *, coalesce(value - lag(value) OVER w, 0) AS g, row_number() OVER w AS i FROM mv WINDOW w AS (PARTITION BY chrom ORDER BY value, sample_id)),
ct AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY g DESC, i) < 3 AND g > 0)::INT AS c FROM gp),
ls AS (SELECT chrom, pos // 200000 * 200000 AS start, s, round(sum(ln(greatest(gl0 / (gl0 + gl1 + gl2), 1e-10))), 6) AS l0, round(sum(ln(greatest(gl1 / (gl0 + gl1 + gl2), 1e-10))), 6) AS l1, round(sum(ln(greatest(gl2 / (gl0 + gl1 + gl2), 1e-10))), 6) AS l2 FROM gl GROUP BY ALL)
SELECT 'ancestry_clusters' AS strategy, 'all' AS chrom, 'Q' || list_position(q, list_max(q)) AS "group", s::VARCHAR AS sample_id FROM ql
UNION ALL SELECT 'precomp_bands', chrom, 'band' || (sum(c) OVER (PARTITION BY chrom ORDER BY value, sample_id) + 1)::BIGINT, sample_id FROM ct
UNION ALL SELECT 'C01i_decomposition', chrom, 'inv_' || chrom || '_' || start || '_' || CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'HOM_A' WHEN l1 >= l2 THEN 'HET' ELSE 'HOM_B' END, s::VARCHAR FROM ls""",
}
