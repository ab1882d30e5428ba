"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Sizes are summed by source and the first bits of that hash; for each source the
bucket is found in which the running sum passes the budget; only the rows of that bucket are summed again by
the next bits, until the bucket holds one hash value or nothing; that one is taken if this comes nearer to the budget. What is left is one threshold for each
source: a document is taken if its hash is below it. No rows are sorted, and thresholds of growing budgets
are nested, so that a smaller mix is part of a larger one.

A source whose target is above its size takes each of its documents whole as often as the target holds the
source, and the rest by the threshold. A target never passes `most` times its source.

Defined results: null text has size 0; the null source is a source of its own and comes last; a document of
size 0 takes 0 words; a document hashes by its id and its text, so that rows without an id or with the same one go apart; rows
equal in both are taken together or not at all; an empty table gives an
empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.native import md5_bits, named, row_key
from lociflow.llm.storage import cut

HASH_BITS, MOST_CELLS = 48, 1 << 20
#: Sources up to which their table is broadcast: a row of it is a name and two numbers.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text: each such run ends where white space or the text's end begins."""
    t = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.length(F.trim(t)) == 0, F.lit(0)).otherwise(F.size(F.split(F.trim(t), " +"))).cast("long")


def water_filled(sizes: list[int], weights: list[int], total: Fraction, most: int) -> list[Fraction]:
    """Shares of total by weight; none above most times its size, the excess shared again by weight."""
    out: list[Fraction | None] = [None] * len(sizes)
    left, open_ = Fraction(total), [i for i in range(len(sizes))]
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] >= most * sizes[i] * w]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if out[i] is None]
    return [x if x is not None else Fraction(0) for x in out]


def _bucket(h: Column, level: int, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits * (level + 1)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def bits_for(sources: int) -> int:
    """Bits of a level: a histogram of all sources stays within MOST_CELLS rows. Divides HASH_BITS."""
    return next((b for b in (12, 8, 6, 4, 3, 2) if sources << b <= MOST_CELLS), 1)


def thresholds(sized: DataFrame, budgets: dict[int, list[Fraction]]) -> dict[int, list[int]]:
    """For each source number the hash prefixes (HASH_BITS bits) below which its sizes sum to at most each of its
    budgets, ascending: one histogram a level, the second and later ones over the boundary buckets alone.

    sized has columns sid, size, h (HASH_BITS bits). A histogram has at most sources x budgets x 2^bits rows, and at most MOST_CELLS."""
    bits = bits_for(len(budgets))
    levels = HASH_BITS // bits
    spark = sized.sparkSession
    state = {(s, k): (0, Fraction(b)) for s, bs in budgets.items() for k, b in enumerate(bs)}
    prefixes, depth = {key: 0 for key in state}, {key: 0 for key in state}
    for level in range(levels):
        live = {key for key, (p, left) in state.items() if left > 0 and p >= 0}
        if not live:
            break
        rows = sized
        if level:
            wanted = spark.createDataFrame([(s, p) for s, p in {(s, prefixes[s, k]) for s, k in live}], "sid int, prefix long")
            small = F.broadcast(wanted) if len(live) <= BROADCAST_SOURCES else wanted
            rows = sized.withColumn("prefix", F.shiftright("h", HASH_BITS - bits * level)).join(small, ["sid", "prefix"])
        else:
            rows = sized.withColumn("prefix", F.lit(0).cast("long"))
        hist: dict[tuple[int, int], list[tuple[int, int]]] = {}
        cells = rows.groupBy("sid", "prefix", _bucket(F.col("h"), level, bits).alias("b")).agg(F.sum("size").alias("size")).toArrow()
        for sid, prefix, b, size in zip(*[cells.column(c).to_pylist() for c in ("sid", "prefix", "b", "size")], strict=True):
            hist.setdefault((sid, prefix), []).append((b, size))
        for s, k in live:
            left, at = state[s, k][1], 1 << bits
            for b, size in sorted(hist.get((s, prefixes[s, k] if level else 0), [])):
                if size > left:
                    at = b
                    if level == levels - 1 and size - left < left:  # one hash value: in if that is nearer
                        at += 1
                    break
                left -= size
            state[s, k] = (at, left)
            prefixes[s, k] = (prefixes[s, k] << bits) + at
            depth[s, k] = level + 1
            if at == 1 << bits:  # the budget holds all of it
                state[s, k] = (-1, left)
    return {s: [prefixes[s, k] << bits * (levels - depth[s, k]) for k in range(len(bs))] for s, bs in budgets.items()}


def _hash(key: str, text: str, seed: int) -> Column:
    """HASH_BITS bits."""
    return md5_bits(row_key(F.col(key), F.col(text)), str(seed), HASH_BITS // 4)


def _copies(h: Column) -> Column:
    return F.col("whole") + (h < F.col("below")).cast("int")


def _mixed(docs: DataFrame, share: Fraction = Fraction(1), weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """The documents as doc_id, source, size, h, and one row for each source: name, source_size, target, whole, below."""
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _hash(key, text, seed).alias("h"))
    sized, _ = cut(sized, "sizes")  # texts are read once; the passes below read four short columns
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    names, sizes = [r["source"] for r in found], [r["n"] for r in found]
    w = [weights[i % len(weights)] for i in range(len(names))]
    targets = water_filled(sizes, w, share * sum(sizes), most)
    whole = [int(t // n) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    rest = [t - q * n for t, q, n in zip(targets, whole, sizes, strict=True)]
    small = F.broadcast if len(names) <= BROADCAST_SOURCES else (lambda x: x)
    known = sized.join(small(spark.createDataFrame([(i, s) for i, s in enumerate(names)], "sid int, name string")), F.col("source").eqNullSafe(F.col("name")))
    limit = thresholds(known.select("sid", "size", "h"), {i: [r] for i, r in enumerate(rest) if r > 0})
    table = spark.createDataFrame([(s, n, float(t), q, limit[i][0] if i in limit else 0) for i, (s, n, t, q) in enumerate(zip(names, sizes, targets, whole, strict=True))], "name string, source_size long, target double, whole int, below long")
    return sized, small(table)


def mix(docs: DataFrame, share: Fraction = Fraction(1), weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken. Sources in order of their code points, null last,
    weigh `weights` in turn and share `share` of all words."""
    sized, table = _mixed(docs, share, weights, most, key, text, source, seed)
    known = sized.join(table, F.col("source").eqNullSafe(F.col("name"))).withColumn("copies", _copies(F.col("h")))
    return known.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = 3) -> DataFrame:
    """Every row as often as the mix takes it. A row finds its copies by its own source and hash, so rows without a doc_id are taken like
    others, and rows that share one each have their own copies."""
    _, table = _mixed(docs, seed=seed)
    row = F.struct(*map(named, docs.columns))  # names of docs and of the table may be the same
    each = docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), _hash("doc_id", "text", seed).alias("h"))
    taken = each.join(table, F.col("source").eqNullSafe(F.col("name"))).withColumn("copies", _copies(F.col("h")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::HUGEINT AS size, ('0x' || substr(md5('3:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM (SELECT source, sum(size)::HUGEINT AS n FROM d GROUP BY source)),
a AS (SELECT sum(n)::HUGEINT AS t, sum(w)::HUGEINT AS ws FROM s),
o AS (SELECT *, coalesce(sum(n) OVER q, 0)::HUGEINT AS nb, coalesce(sum(w) OVER q, 0)::HUGEINT AS wb FROM s WINDOW q AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT o.*, (t - 3 * nb) * w >= 3 * n * (ws - wb) AS full_ FROM o, a),
c AS (SELECT t - 3 * coalesce(sum(n) FILTER (full_), 0)::HUGEINT AS left_, ws - coalesce(sum(w) FILTER (full_), 0)::HUGEINT AS wl FROM f, a GROUP BY t, ws),
g AS (SELECT source, n, CASE WHEN full_ THEN 3 * n ELSE left_ * w END AS num, CASE WHEN full_ THEN 1 ELSE wl END AS den FROM f, c),
b AS (SELECT *, CASE WHEN n > 0 THEN num // (den * n) ELSE 0 END AS whole FROM g),
hs AS (SELECT source, h, sum(size)::HUGEINT AS m, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::HUGEINT AS upto FROM d GROUP BY source, h),
tk AS (SELECT hs.source, h, upto * den <= num - whole * n * den OR ((upto - m) * den < num - whole * n * den AND upto * den - (num - whole * n * den) < (num - whole * n * den) - (upto - m) * den) AS yes FROM hs JOIN b ON b.source IS NOT DISTINCT FROM hs.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, num::DOUBLE / den::DOUBLE AS target, (size * (whole + (yes AND num > whole * n * den)::INT))::BIGINT AS taken
FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source JOIN tk ON tk.source IS NOT DISTINCT FROM d.source AND tk.h = d.h
"""
