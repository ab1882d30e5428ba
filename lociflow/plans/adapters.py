"""The driver's tables read as domain tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype likelihoods from lineitem: chrom, pos, sample_idx, gl0, gl1, gl2; ten samples at every site."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("ln"), ((F.floor(F.col("l_partkey") / 5)) * 1000 + 1).cast("long").alias("pos"), (F.col("l_suppkey") % SAMPLES).cast("int").alias("sample_idx"),
        F.col("l_quantity").alias("a"), F.round(100 * F.col("l_discount")).alias("b"), F.round(100 * F.col("l_tax")).alias("c"), F.lit(1).alias("k"))
    empty = rows.select("ln", "pos").distinct().select("ln", "pos", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("sample_idx"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0).alias("k"))
    cells = rows.unionByName(empty).groupBy("ln", "pos", "sample_idx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("k").alias("k"))
    a, b, c = F.when(F.col("k") == 0, 1.0).otherwise(F.col("a")), F.col("b") + 1, F.col("c") + 1
    swap = (F.col("sample_idx") >= 5) & (F.floor(F.col("pos") / 1000) % 10 < (F.floor(F.col("pos") / 50000) + F.col("ln")) % 8)
    return cells.select(F.concat(F.lit("chr"), "ln").alias("chrom"), "pos", "sample_idx", F.when(swap, c).otherwise(12 * a).alias("gl0"), b.alias("gl1"), F.when(swap, 12 * a).otherwise(c).alias("gl2"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of gl, once for each row of lineitem: chrom, pos."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), (F.floor(F.col("l_partkey") / 5) * 1000 + 1).cast("long").alias("pos"))


SQL_GL = """cells AS (
  SELECT ln, pos, s, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(k) AS k FROM (
    SELECT l_linenumber AS ln, (l_partkey // 5) * 1000 + 1 AS pos, (l_suppkey % 10)::INT AS s, l_quantity AS a, round(100 * l_discount) AS b, round(100 * l_tax) AS c, 1 AS k FROM lineitem
    UNION ALL SELECT DISTINCT l_linenumber, (l_partkey // 5) * 1000 + 1, i.i::INT, 0.0, 0.0, 0.0, 0 FROM lineitem, range(10) AS i(i)) GROUP BY ln, pos, s),
gl AS (SELECT 'chr' || ln AS chrom, pos, s, sw, CASE WHEN sw THEN c + 1 ELSE 12 * (CASE WHEN k = 0 THEN 1 ELSE a END) END::DOUBLE AS gl0, (b + 1)::DOUBLE AS gl1, CASE WHEN sw THEN 12 * (CASE WHEN k = 0 THEN 1 ELSE a END) ELSE c + 1 END::DOUBLE AS gl2
  FROM (SELECT *, s >= 5 AND (pos // 1000) % 10 < ((pos // 50000) + ln) % 8 AS sw FROM cells)),
dos AS (SELECT chrom, pos, s, (gl1 + 2 * gl2) / (gl0 + gl1 + gl2) AS d, greatest(gl0, gl1, gl2) / (gl0 + gl1 + gl2) AS peak, gl1 / (gl0 + gl1 + gl2) AS h FROM gl),
grp(g, s) AS (VALUES ('HOM_A', 0), ('HOM_A', 1), ('HOM_A', 2), ('HOM_A', 3), ('HET', 4), ('HET', 5), ('HET', 6), ('HOM_B', 7), ('HOM_B', 8), ('HOM_B', 9)),
pops(g, s) AS (VALUES ('P1', 0), ('P1', 1), ('P1', 2), ('P2', 3), ('P2', 4), ('P3', 5), ('P3', 6), ('P3', 7), ('O', 8), ('O', 9))"""


def _members(spark: SparkSession, sets: dict[str, range]) -> DataFrame:
    return spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "group string, sample_idx int")


def groups(spark: SparkSession) -> DataFrame:
    return _members(spark, {"HOM_A": range(0, 4), "HET": range(4, 7), "HOM_B": range(7, 10)})


def populations(spark: SparkSession) -> DataFrame:
    return _members(spark, {"P1": range(0, 3), "P2": range(3, 5), "P3": range(5, 8), "O": range(8, 10)})


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of half-overlapping days over events: chrom, start, end, stat (mean value), n_variants."""
    from lociflow.operators.windows import fixed_grid

    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1704067200).cast("long").alias("pos"), "value")
    return fixed_grid(points, 86400, 43200).groupBy("chrom", "start", "end").agg(F.round(F.avg("value"), 9).alias("stat"), F.count(F.lit(1)).alias("n_variants"))


SQL_TRACK = """pts AS (SELECT event_type AS chrom, (epoch_us(ts) // 1000000 - 1704067200)::BIGINT AS pos, value FROM events),
track AS (SELECT chrom, w * 43200 AS start, w * 43200 + 86399 AS "end", round(avg(value), 9) AS stat, count(*) AS n_variants
  FROM (SELECT *, unnest(range(greatest(0, (pos - 86399 + 43199) // 43200), pos // 43200 + 1)) AS w FROM pts) GROUP BY chrom, w)"""


def hwe_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HWE site table from orders: chrom, pos, freq, f."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("chrom"), F.col("o_orderkey").alias("pos"), ((F.floor(F.col("o_totalprice")) % 1000) / 1000).alias("freq"), ((F.col("o_custkey") % 41 - 20) / 20).alias("f"))


SQL_HWE = "hwe AS (SELECT o_orderpriority AS chrom, o_orderkey AS pos, (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS freq, (o_custkey % 41 - 20) / 20.0::DOUBLE AS f FROM orders)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered labels: parent, sample (user), ord, label, and three numbers for each."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("parent"), F.col("user_id").alias("sample"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("label"), F.col("value").alias("delta12"))


SQL_LABELS = "lab AS (SELECT user_id % 4 AS parent, user_id AS sample, event_type AS label, value AS delta12, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homology hits from lineitem."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("query"), F.concat(F.lit("t"), "l_suppkey").alias("target"), F.col("l_extendedprice").alias("bitscore"), (1 - F.col("l_discount")).alias("identity"), F.when(F.col("l_linestatus") == "O", "diamond").otherwise("miniprot").alias("source_type"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("hit_id"))


SQL_HITS = "hits AS (SELECT l_partkey::VARCHAR AS query, 't' || l_suppkey AS target, l_extendedprice AS bitscore, 1 - l_discount AS identity, CASE WHEN l_linestatus = 'O' THEN 'diamond' ELSE 'miniprot' END AS source_type, l_orderkey || ':' || l_linenumber AS hit_id FROM lineitem)"


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes from part, spread over the chromosomes of the track."""
    kinds = F.array(*[F.lit(x) for x in TRACK_CHROMS])
    return table(spark, sf_dir, "part").select(F.get(kinds, (F.col("p_partkey") % len(TRACK_CHROMS)).cast("int")).alias("chrom"), (F.col("p_partkey") * 1300).alias("start"), (F.col("p_partkey") * 1300 + F.col("p_size") * 100).alias("end"), F.concat(F.lit("g"), "p_partkey").alias("gene_id"), F.col("p_partkey").alias("ord"))


TRACK_CHROMS = ("click", "purchase", "view", "signup", "error")
SQL_GENES = "genes AS (SELECT ['" + "','".join(TRACK_CHROMS) + "'][(p_partkey % 5 + 1)::INT] AS chrom, p_partkey * 1300 AS start, p_partkey * 1300 + p_size * 100 AS \"end\", 'g' || p_partkey AS gene_id, p_partkey AS ord FROM part)"


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

K = 3


def q_matrix(spark: SparkSession) -> DataFrame:
    """Admixture proportions of the ten samples: md5 numbers, normalised."""
    from lociflow.functions.expr import hash_int

    raw = F.array(*[hash_int(F.concat_ws("-", F.lit("q"), "id", F.lit(str(k)))) + 1.0 for k in range(K)])
    q = spark.range(SAMPLES).select(F.col("id").cast("int").alias("sample_idx"), raw.alias("r"))
    return q.select("sample_idx", F.transform("r", lambda x: x / F.aggregate("r", F.lit(0.0), lambda a, y: a + y)).alias("q"))


def f_matrix(sites: DataFrame) -> DataFrame:
    """Ancestral frequencies of sites: md5 numbers scaled to (0, 1)."""
    from lociflow.functions.expr import hash_int

    return sites.select("chrom", "pos").distinct().select("chrom", "pos", F.array(*[(hash_int(F.concat_ws("-", F.lit("f"), "chrom", F.col("pos").cast("string"), F.lit(str(k)))) + 0.5) / 4294967296.0 for k in range(K)]).alias("f"))


_X = "concat('0x', substr(md5({0}), 1, 8))::UBIGINT::DOUBLE"
SQL_Q = "qr AS (SELECT i::INT AS s, k::INT AS k, " + _X.format("'q-' || i || '-' || k") + " + 1.0 AS r FROM range(10) AS a(i), range(3) AS b(k)), qm AS (SELECT s, k, r / sum(r) OVER (PARTITION BY s) AS x FROM qr), ql AS (SELECT s, list(x ORDER BY k) AS q FROM qm GROUP BY s)"
SQL_F = "fm AS (SELECT DISTINCT chrom, pos, k::INT AS k, (" + _X.format("'f-' || chrom || '-' || pos || '-' || k") + " + 0.5) / 4294967296.0 AS f FROM gl, range(3) AS b(k))"

#: Shares of sites at which each genotype is a sample's likeliest: q as a list.
SQL_SHARES = "sk AS (SELECT s, CASE WHEN gl0 >= gl1 AND gl0 >= gl2 THEN 0 WHEN gl1 >= gl2 THEN 1 ELSE 2 END AS k FROM gl), ql AS (SELECT s, [avg((k = 0)::INT), avg((k = 1)::INT), avg((k = 2)::INT)] AS q FROM sk GROUP BY s)"
