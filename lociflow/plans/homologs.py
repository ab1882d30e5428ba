"""Queries of homology hits and registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import homologs as ho
from lociflow.plans import adapters as ad
from lociflow.plans.ancestry import _SC, _site_candidates
from lociflow.plans.popstats import rounded
from lociflow.sources import readers, scratch


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return ho.interval_registry(ad.gl(spark, d), _site_candidates(spark))


def _subsets(spark: SparkSession, d: str) -> DataFrame:
    q = ho.likelihood_shares(ad.gl(spark, d))
    return ho.sample_subsets(q, q.filter(F.array_max("q") >= 0.5).select("sample_idx"))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """All hits written as an index; the genes of one brand, and of customers, who have none, looked up in it at once."""
    path = scratch.folder(spark, "index")
    ho.write_index(ad.hits(spark, d), path)
    brand = ad.table(spark, d, "part").filter(F.col("p_brand") == "Brand#11").select(F.col("p_partkey").cast("string").alias("query"))
    return ho.lookup_many(spark, path, brand.unionByName(ad.table(spark, d, "customer").select(F.col("c_name").alias("query"))), 3, source="diamond", min_identity=0.93)


def _hit_text(spark: SparkSession, d: str) -> DataFrame:
    """Hits written in the twelve fields of a protein aligner and read back."""
    path = scratch.folder(spark, "hits")
    row = F.concat_ws("\t", F.col("l_partkey"), F.concat(F.lit("t"), "l_suppkey"), F.round(100 * (1 - F.col("l_discount")), 2), F.col("l_quantity").cast("long"), F.lit(0), F.lit(0), F.lit(1), F.col("l_quantity").cast("long"), F.lit(1), F.col("l_quantity").cast("long"), F.lit("1e-10"), F.col("l_extendedprice"))
    ad.table(spark, d, "lineitem").select(row.alias("value")).write.text(path)
    got = readers.diamond(spark, path)
    return got.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("bitscore"), 4).alias("best"), F.round(F.min("identity"), 6).alias("least_identity"), F.sum("aln_len").alias("aln_len"), F.countDistinct("target").alias("n_targets"))


QUERIES = {
    "hits_gene_records": lambda s, d: ho.gene_records(ad.hits(s, d)),
    "hits_top": lambda s, d: rounded(ho.top_hits(ad.hits(s, d), 3, "diamond", 0.93, 10_000.0)),
    "hits_orthologs": lambda s, d: rounded(ho.top_hits(ho.orthologs(ad.hits(s, d)), 5)),
    "hits_paralogs": lambda s, d: rounded(ho.top_hits(ho.paralogs(ad.hits(s, d)), 5)),
    "hits_lookup": lambda s, d: rounded(_indexed(s, d)),
    "io_hits": _hit_text,
    "registry_intervals": _registry,
    "registry_sample_subsets": _subsets,
}

_H = ad.with_ctes(ad.SQL_HITS)
_TOP = "SELECT query, target, round(bitscore, 6) AS bitscore, round(identity, 6) AS identity, source_type, hit_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bitscore DESC, identity DESC, target, hit_id)::INT AS rank FROM hits WHERE {0}) WHERE rank <= {1}"
SQL = {
    "hits_gene_records": _H + "SELECT query, (sum(n) OVER (ORDER BY query) - n)::BIGINT AS first_hit, n AS n_hits FROM (SELECT query, count(*) AS n FROM hits GROUP BY query)",
    "hits_top": _H + _TOP.format("source_type = 'diamond' AND identity >= 0.93 AND bitscore >= 10000", 3),
    "hits_orthologs": _H + _TOP.format("source_type = 'miniprot'", 5),
    "hits_paralogs": _H + _TOP.format("source_type = 'diamond' AND query <> target", 5),
    "registry_intervals": ad.with_ctes(ad.SQL_GL) + _SC + """, st AS (SELECT DISTINCT chrom, pos FROM gl), nu AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM st),
wi AS (SELECT *, unnest(range(greatest(0, (i - 99 + 19) // 20), least(greatest(0, (n - 100) // 20), i // 20) + 1)) + 1 AS w FROM nu)
SELECT 'genome' AS kind, 'genome' AS name, NULL::VARCHAR AS chrom, NULL::BIGINT AS start, NULL::BIGINT AS "end", count(*) AS n_markers FROM st UNION ALL SELECT 'chromosome', chrom, chrom, min(pos), max(pos), count(*) FROM st GROUP BY chrom
UNION ALL SELECT 'snp_window', chrom || '_' || w, chrom, min(pos), max(pos) + 1, count(*) FROM wi GROUP BY chrom, w UNION ALL SELECT 'candidate', candidate_id, chrom, start, "end", (SELECT count(*) FROM st WHERE st.chrom = cand.chrom AND pos BETWEEN cand.start AND cand."end") FROM cand""",
    "hits_lookup": _H + """, w AS (SELECT p_partkey::VARCHAR AS query FROM part WHERE p_brand = 'Brand#11' UNION SELECT c_name FROM customer), t AS (SELECT query, count(*) AS n FROM hits GROUP BY query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bitscore DESC, identity DESC, target, hit_id)::INT AS rank FROM hits WHERE source_type = 'diamond' AND identity >= 0.93), b AS (SELECT * FROM r WHERE rank <= 3), e AS (SELECT query, count(*) AS m FROM b GROUP BY query)
SELECT w.query, n IS NOT NULL AS found, coalesce(n, 0) AS n_hits_total, coalesce(m, 0) AS n_hits_emitted, rank, target, round(bitscore, 6) AS bitscore, round(identity, 6) AS identity, source_type, hit_id FROM w LEFT JOIN t USING (query) LEFT JOIN e USING (query) LEFT JOIN b USING (query)""",
    "io_hits": "SELECT l_partkey::VARCHAR AS query, count(*) AS n, round(max(l_extendedprice), 4) AS best, round(min(1 - l_discount), 6) AS least_identity, sum(l_quantity::BIGINT)::BIGINT AS aln_len, count(DISTINCT l_suppkey) AS n_targets FROM lineitem GROUP BY 1",
    "registry_sample_subsets": ad.with_ctes(ad.SQL_GL, ad.SQL_SHARES) + ", a AS (SELECT s AS sample_idx, list_position(q, list_max(q))::INT AS cluster, list_max(q) AS m FROM ql) SELECT 'all' AS subset, sample_idx, cluster FROM a UNION ALL SELECT 'pruned', sample_idx, cluster FROM a WHERE m >= 0.5",
}
