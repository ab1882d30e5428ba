"""Removal of lines that many documents share, in DataFrame functions alone.

Lines are exploded with their position and keep only two hashes (128 bits) of their normalised form; texts stay where they are. Each
hash counts its distinct documents, in part before the shuffle and by hash and document first, so that a very common line is many small
groups. Hashes over the threshold keep their line in one document, and the positions of the other lines go back to the documents: a text
moves only if it loses a line, and a bitmap tells which do. What stands between dropped positions is sliced out and joined again.

Defined results: null and empty texts are one empty line; a document is its doc_id, so that repeated rows count once, each of them is
cleaned alike, and rows that share the largest doc_id all keep the line; rows without a doc_id count as one document, which is less than
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.native import LOWER, UPPER, let, sha256_hex
from lociflow.llm.storage import cut, drop, sieved

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_LENGTH, LEAST_DOCS = 20, 3
#: Rows of shared lines, or of documents that lose lines, up to which they are broadcast; above, the joins shuffle.
BROADCAST_ROWS = 200_000


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of the lines whose key has `least` code points or more."""
    each = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
    low = F.when(F.length("line") == F.octet_length("line"), F.lower("line")).otherwise(F.translate("line", UPPER, LOWER))
    keyed = each.filter(F.length("line") >= least).select("doc_id", "text_hash", "pos", low.alias("key"))
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(12), "key").alias("h2"))


def shared_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, keeper: the hashes found in `least_docs` documents or more, and the largest doc_id that holds them."""
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max(F.col("doc_id").isNull().cast("int")).alias("none"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n") + F.col("none") >= least_docs).select("h1", "h2", "keeper")


def _dropped(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text_hash, places of the lines that go."""
    if shared.count() <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(shared), ["h1", "h2"])
    else:
        met = sieved(lines, F.col("h1"), shared.select("h1"), "near").filter("near").join(shared, ["h1", "h2"])
    lost = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def without_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: a row for each row of docs, with what is left of its text."""
    base = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lines, at = cut(_lines(base, least_length), "lines")
    shared, over = cut(shared_lines(lines, least_docs), "shared")
    lost, _ = cut(_dropped(lines, shared), "lost")
    drop(docs.sparkSession, at, over)
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))

    def cleaned(x):
        """n, lost and kept of the lines x; a text without places stays as it is."""
        parts = lambda lines: let(F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.size(lines))), lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice(lines, e[i] + 2, e[i + 1] - e[i] - 1)))
        rest = lambda lines: F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts(lines)), "\n"))
        return let(x, lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"), rest(lines).alias("kept")))

    rows, places = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and places <= 10 * BROADCAST_ROWS:
        met = base.alias("d").join(F.broadcast(lost).alias("l"), same("d", "l"), "left").select("d.doc_id", "text", "places")
    else:
        marked = sieved(base, F.col("text_hash"), lost.select("text_hash"), "near")
        met = marked.filter("near").alias("d").join(lost.alias("l"), same("d", "l"), "left").select("d.doc_id", "text", "places")
        met = met.unionByName(marked.filter("not near").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places")))
    return met.select("doc_id", cleaned(F.split("text", "\n")).alias("x")).select("doc_id", "x.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept")).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id <> keeper AS lost FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
