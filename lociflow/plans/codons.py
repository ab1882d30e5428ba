"""Queries of codon statistics, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import codons as co
from lociflow.plans import adapters as ad
from lociflow.plans.popstats import rounded
from lociflow.sources import readers, scratch, writers

_FROM = "abcdefghijklmnopqrstuvwxyz"
_TO = "acgtacgtacgtacgtacgtac-tac"


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Sequences from documents: their letters a-z as nucleotides, one of them as a gap."""
    code, other = bytes.maketrans(_FROM.encode(), _TO.upper().encode()), bytes(x for x in range(256) if x not in _FROM.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(x.as_py() or "").encode("ascii", "replace").translate(code, other).decode("ascii") for x in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(seqs, pa.string())], ["doc_id", "seq"])

    rows = ad.table(spark, d, "documents").select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, seq string")


def cds_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _letters(spark, d)
    j = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("seq_b")), "doc_id")
    n = F.greatest(F.length("seq"), F.length("seq_b"))  # the shorter one is filled with gaps
    return j.select(F.col("doc_id").alias("pair_id"), F.rpad("seq", n, F.lit("-")).alias("seq_a"), F.rpad("seq_b", n, F.lit("-")).alias("seq_b"))


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written as records of many lines and read back."""
    path = scratch.folder(spark, "fasta")
    writers.write_fasta(_letters(spark, d).select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(" a>b")).alias("name"), "seq"), path)
    return readers.fasta(spark, path).select("name", F.length("seq").alias("length"), F.sha2(F.col("seq"), 256).alias("sha256"))


def haplotypes(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select((F.col("doc_id") % 20).alias("locus"), F.col("doc_id").alias("hap_ord"), "seq")


def coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, 0.5 + i / 10) for i in range(10)], "locus long, factor double")


def _kappa(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(co.estimate_kappa(cds_pairs(spark, d)),)], "kappa double")


def _yn(spark: SparkSession, d: str) -> DataFrame:
    return co.pair_statistics(cds_pairs(spark, d), "YN00", 2.0)


QUERIES = {
    "io_fasta": _fasta,
    "codon_pair_ng86": lambda s, d: rounded(co.pair_statistics(cds_pairs(s, d)), 5),
    "codon_pair_k80": lambda s, d: rounded(_yn(s, d), 5),
    "codon_kappa": lambda s, d: rounded(_kappa(s, d), 5),
    "codon_diversity": lambda s, d: rounded(co.diversity(co.codon_diversity(haplotypes(s, d), ["locus"]), ["locus"], coverage(s)), 5),
    "codon_bootstrap": lambda s, d: rounded(co.codon_bootstrap(co.codon_diversity(haplotypes(s, d), ["locus"]), ["locus"]), 5),
}


def _pairs(kappa: float) -> str:
    return "ct(a, b, s, sd_ts, sd_tv, nd_ts, nd_tv, f4, d4, ts4, ts, tv) AS (VALUES " + ", ".join("('" + r[0] + "', '" + r[1] + "', " + ", ".join(f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r[2:]) + ")" for r in co.pair_rows(kappa)) + ")"


_SEQ = f"sq AS (SELECT doc_id, upper(translate(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}')) AS seq FROM documents)"
_AL = """pr AS (SELECT x.doc_id AS pair_id, greatest(length(x.seq), length(y.seq)) AS n_bp, rpad(x.seq, greatest(length(x.seq), length(y.seq))::INT, '-') AS sa, rpad(y.seq, greatest(length(x.seq), length(y.seq))::INT, '-') AS sb FROM sq x JOIN sq y ON y.doc_id = x.doc_id + 1),
cd AS (SELECT pair_id, n_bp, unnest(regexp_extract_all(sa, '...')[1:n_bp // 3]) AS a, unnest(regexp_extract_all(sb, '...')[1:n_bp // 3]) AS b FROM pr),
gs AS (SELECT pair_id, count(*) AS n_codons_total, count(*) FILTER (contains(a, '-') OR contains(b, '-')) AS n_codons_gap, count(s) AS n_codons_used, round(coalesce(sum(s), 0), 9) AS s, round(coalesce(sum(sd_ts), 0), 9) AS st, round(coalesce(sum(sd_tv), 0), 9) AS sv, round(coalesce(sum(nd_ts), 0), 9) AS nt, round(coalesce(sum(nd_tv), 0), 9) AS nv, coalesce(sum(f4), 0)::BIGINT AS f4, coalesce(sum(d4), 0)::BIGINT AS d4, coalesce(sum(ts4), 0)::BIGINT AS ts4 FROM cd LEFT JOIN ct USING (a, b) GROUP BY pair_id),
g AS (SELECT pr.pair_id, pr.n_bp, coalesce(n_codons_total, 0) AS n_codons_total, coalesce(n_codons_gap, 0) AS n_codons_gap, coalesce(n_codons_used, 0) AS n_codons_used, coalesce(s, 0) AS s, coalesce(st, 0) AS st, coalesce(sv, 0) AS sv, coalesce(nt, 0) AS nt, coalesce(nv, 0) AS nv, coalesce(f4, 0) AS f4, coalesce(d4, 0) AS d4, coalesce(ts4, 0) AS ts4, 3.0 * coalesce(n_codons_used, 0) - coalesce(s, 0) AS n FROM pr LEFT JOIN gs USING (pair_id))"""


def _jc(p: str) -> str:
    return f"CASE WHEN {p} IS NULL OR {p} < 0 THEN NULL WHEN {p} >= 0.75 THEN 'inf'::DOUBLE ELSE -0.75 * ln(greatest(1 - 4 * {p} / 3, 1e-300)) END"


def _k80(p: str, q: str) -> str:
    return f"CASE WHEN {p} IS NULL OR {q} IS NULL THEN NULL WHEN 1 - 2*{p} - {q} <= 0 OR 1 - 2*{q} <= 0 THEN 'inf'::DOUBLE ELSE -0.5 * ln(greatest(1 - 2*{p} - {q}, 1e-300)) - 0.25 * ln(greatest(1 - 2*{q}, 1e-300)) END"


def _stats(kappa: float, k80: bool) -> str:
    w = lambda x, n: f"(CASE WHEN {n} > 0 THEN ({x})::DOUBLE / {n} END)"
    ds = _k80(w("st", "s"), w("sv", "s")) if k80 else _jc(w("st + sv", "s"))
    dn = _k80(w("nt", "n"), w("nv", "n")) if k80 else _jc(w("nt + nv", "n"))
    d4 = _k80(w("ts4", "f4"), w("d4 - ts4", "f4")) if k80 else _jc(w("d4", "f4"))
    return f"""WITH {_pairs(kappa)}, {_SEQ}, {_AL}, h AS (SELECT *, {ds} AS ds, {dn} AS dn, {d4} AS q4 FROM g)
SELECT pair_id, n_bp, n_codons_total, n_codons_gap, n_codons_total - n_codons_gap - n_codons_used AS n_codons_stop, n_codons_used, round(s, 5) AS S, round(n, 5) AS N_sites, round(st + sv, 5) AS sd, round(nt + nv, 5) AS nd, round({w("st + sv", "s")}, 5) AS pS, round({w("nt + nv", "n")}, 5) AS pN,
 round(ds, 5) + 0.0 AS dS, round(dn, 5) + 0.0 AS dN, f4 AS n_4d_sites, d4 AS n_4d_diffs, round({w("d4", "f4")}, 5) AS p4d, round(q4, 5) + 0.0 AS d4d, CASE WHEN isfinite(ds) AND ds > 0 THEN round(dn / ds, 5) + 0.0 END AS omega FROM h"""


_DEG = "dg(c, s, g1, g2, g3) AS (VALUES " + ", ".join(f"('{c}', {co.synonymous_sites(c)}::DOUBLE, " + ", ".join(str(co.degeneracy(c, p)) for p in range(3)) + ")" for c in co.CODONS if co.AMINO[c] != "*") + ")"


_DIV = f"""WITH {_pairs(1.0)}, {_DEG}, {_SEQ}, hp AS (SELECT doc_id % 20 AS locus, doc_id AS o, regexp_extract_all(seq, '...') AS cs FROM sq),
ex AS (SELECT locus, o, unnest(cs) AS c, unnest(range(len(cs))) AS k FROM hp), hs AS (SELECT locus, k, c, count(*) AS n, min(o) AS o FROM ex JOIN dg USING (c) GROUP BY locus, k, c),
pl AS (SELECT locus, k, sum(n)::DOUBLE AS n, arg_min(c, o) AS ref, sum(n * s) / sum(n) AS ms FROM hs JOIN dg USING (c) GROUP BY locus, k HAVING sum(n) >= 2),
sb AS (SELECT x.locus, x.k, sum(x.n * y.n * (sd_ts + sd_tv)) / 2 AS sd, sum(x.n * y.n * (nd_ts + nd_tv)) / 2 AS nd FROM hs x JOIN hs y ON x.locus = y.locus AND x.k = y.k JOIN ct ON ct.a = x.c AND ct.b = y.c GROUP BY ALL),
nt AS (SELECT locus, k, p, sum(m * m) AS q FROM (SELECT locus, k, p, substr(c, p::INT, 1) AS v, sum(n) AS m FROM hs, range(1, 4) AS r(p) GROUP BY ALL) GROUP BY ALL),
fd AS (SELECT locus, k, sum((g = 3)::INT) AS n4, sum(CASE WHEN g = 3 THEN df ELSE 0 END) AS d4, sum((g = 0)::INT) AS n0, sum(CASE WHEN g = 0 THEN df ELSE 0 END) AS d0 FROM (SELECT nt.locus, nt.k, CASE p WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END AS g, (pl.n * pl.n - q) / 2 / (pl.n * (pl.n - 1) / 2) AS df FROM nt JOIN pl USING (locus, k) JOIN dg ON dg.c = pl.ref) GROUP BY locus, k),
lc AS (SELECT locus, count(*) AS n_codons, sum(ms) AS s, sum(sd / (n * (n - 1) / 2)) AS sd, sum(nd / (n * (n - 1) / 2)) AS nd, sum(n4) AS n4, sum(d4) AS d4, sum(n0) AS n0, sum(d0) AS d0 FROM pl JOIN sb USING (locus, k) JOIN fd USING (locus, k) GROUP BY locus),
pi AS (SELECT locus, n_codons, sd / s AS a, nd / (3.0 * n_codons - s) AS b, d4 / n4 AS c, d0 / n0 AS d, CASE WHEN locus < 10 THEN 0.5 + locus / 10.0::DOUBLE ELSE 1.0 END AS factor FROM lc)
SELECT locus, n_codons, round(a, 5) AS pi_S, round(b, 5) AS pi_N, round(c, 5) AS pi_4, round(d, 5) AS pi_0, round(b / a, 5) AS pi_NS, round(d / c, 5) AS pi_04, round(a / factor, 5) AS pi_S_corrected, round(b / factor, 5) AS pi_N_corrected, round(c / factor, 5) AS pi_4_corrected, round(d / factor, 5) AS pi_0_corrected, round(factor, 5) AS factor FROM pi"""
SQL = {
    "io_fasta": f"WITH {_SEQ} SELECT 'd' || doc_id AS name, length(seq)::INT AS length, sha256(seq) AS sha256 FROM sq",
    "codon_pair_ng86": _stats(1.0, False),
    "codon_pair_k80": _stats(2.0, True),
    "codon_kappa": f"WITH {_pairs(1.0)}, {_SEQ}, {_AL}, k AS (SELECT sum(ts) / (3.0 * count(*)) AS p, sum(tv) / (3.0 * count(*)) AS q FROM cd JOIN ct USING (a, b)) SELECT round(CASE WHEN 1 - 2*p - q <= 0 OR 1 - 2*q <= 0 THEN 2 WHEN (-0.5 * ln(1 - 2*p - q) + 0.25 * ln(1 - 2*q)) / (-0.25 * ln(1 - 2*q)) > 0 THEN (-0.5 * ln(1 - 2*p - q) + 0.25 * ln(1 - 2*q)) / (-0.25 * ln(1 - 2*q)) ELSE 2 END, 5) AS kappa FROM k",
    "codon_diversity": _DIV,
}
