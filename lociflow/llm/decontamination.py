"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are lower-cased runs of letters and digits. Of each window of w neighbouring k-gram hashes the least is kept, on both sides;
texts that share a span of w + k - 1 words share such a fingerprint. Texts are winnowed in their row, before anything is joined: a
fingerprint is one row with the run of windows whose least hash it is. These rows meet the benchmark's, and a hit is extended to
the spans of w + k - 1 words of its run. These few spans alone leave the document, and only those that equal a span of an item
word by word count. Items shorter than the span count as one window of their own length (k is
that length and w is 1). A span's items are gathered before documents meet it, so that a passage of many items and many
documents does not multiply rows.

Defined results: null and empty texts have no words, no hits and the digest of an empty list; items without words match nothing;
equal rows get equal results; rows that share doc_id but not text are told apart by their text, and a null doc_id is a value like
any other; an empty benchmark leaves every document clean; other columns are ignored, and `stage` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.native import indices, let, lower_ascii, sha256_hex
from lociflow.llm.storage import cut, only, sieved, without

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN, K = 10, 6
#: Rows of a benchmark table up to which it is broadcast (a hash, or ten words); above, the join shuffles.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _grams(h: Column, k: int) -> Column:
    """Hashes of all k-grams of words with the hashes h, by position."""
    return F.transform(indices(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))


def _runs(h: Column, k: int, window: int) -> Column:
    """Fingerprints h of a text with the word hashes given, each with the first and the last of the neighbouring windows of `window` k-grams
    whose least hash it is, as numbers of their first words."""
    def least(g: Column) -> Column:
        return F.transform(indices(F.size(g) - (window - 1)), lambda i: F.least(*[g[i + j] for j in range(window)]) if window > 1 else g[i])

    def runs(m: Column) -> Column:
        begin = F.filter(indices(F.size(m)), lambda i: ~F.get(m, i - 1).eqNullSafe(m[i]))
        return let(begin, lambda s: F.transform(indices(F.size(s)), lambda j: F.struct(m[s[j]].alias("h"), s[j].alias("first"), (F.coalesce(F.get(s, j + 1), F.size(m)) - 1).alias("last"))))

    return let(let(_grams(h, k), least), runs)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _benchmark(benchmark: DataFrame, span: int, k: int, item: str, item_text: str) -> tuple[list[int], DataFrame, DataFrame]:
    """Lengths of the items shorter than span; fingerprints h; and every window (its words) with the items that hold it."""
    items, _ = cut(benchmark.select(F.col(item).cast("string").alias("item_id"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0), "items")
    short = sorted(r[0] for r in items.filter(F.size("w") < span).select(F.size("w")).distinct().collect())  # at most span - 1 numbers
    marks = None
    for n in [*short, span]:
        own = items.filter(F.size("w") >= span) if n == span else items.filter(F.size("w") == n)
        h = let(F.transform("w", lambda x: F.xxhash64(x)), lambda x: _runs(x, k, span - k + 1)["h"] if n == span else F.array(F.xxhash64(*[x[j] for j in range(n)])))
        one = own.select(F.explode_outer(h).alias("h"))
        marks = one if marks is None else marks.unionByName(one)
    at = F.transform(indices(F.greatest(F.size("w") - (span - 1), F.lit(1))), lambda i: F.slice("w", i + 1, span))
    windows = items.select("item_id", F.explode(at).alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return short, cut(marks.distinct(), "marks")[0], cut(windows.withColumn("owners", F.xxhash64("items")), "windows")[0]


def _known(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose h is a fingerprint of the benchmark. Few fingerprints are broadcast; of more, a bitmap of bounded size is, and only
    rows that it knows move."""
    if marks.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(marks), "h")
    return sieved(rows, F.col("h"), marks, "_known").filter("_known").drop("_known").join(marks, "h")


def _places(docs: DataFrame, short: list[int], marks: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, text_hash and the places (length, first and last start of windows) at which a document has a fingerprint of the benchmark.
    Texts are winnowed where they lie: rows that leave the scan are fingerprints, about one for three words, and hold no words."""
    def made(w: Column) -> Column:
        whole = lambda h, n: F.transform(indices(F.size(h) - (n - 1)), lambda i: F.struct(F.lit(n).alias("length"), F.xxhash64(*[h[i + j] for j in range(n)]).alias("h"), i.alias("first"), i.alias("last")))
        long = lambda h: F.transform(_runs(h, k, span - k + 1), lambda x: F.struct(F.lit(span).alias("length"), x["h"].alias("h"), x["first"].alias("first"), x["last"].alias("last")))
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(long(h), *[whole(h, n) for n in short]))

    # bound by let and exploded with outer: predicates that the optimizer pushes down would copy what they name into lambdas
    row = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), let(words(F.col("text")), made).alias("x"))
    met = _known(row.select("doc_id", "text_hash", F.explode_outer("x").alias("x")).select("doc_id", "text_hash", "x.length", "x.h", "x.first", "x.last"), marks)
    return met.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("length", "first", "last"))).alias("places"))


def _hits(docs: DataFrame, short: list[int], marks: DataFrame, windows: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, text_hash, start, length, owners of every place in a document where a window of an item stands. docs: doc_id, text. Only
    documents that share a fingerprint are split again, and only their texts move."""
    places, _ = cut(_places(docs, short, marks, span, k), "places")
    hashed = only(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"), places.select("text_hash"), "text_hash", BROADCAST_ROWS).distinct()
    near = hashed.alias("d").join(places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))).select("d.doc_id", "d.text_hash", "text", "places")

    def around(w: Column) -> Column:
        """start and words of the windows at the places."""
        of = lambda x: F.transform(F.sequence(x["first"], x["last"]), lambda i: F.struct(i.alias("start"), F.slice(w, i + 1, x["length"]).alias("words")))
        return F.flatten(F.transform("places", of))

    each = near.select("doc_id", "text_hash", let(words(F.col("text")), around).alias("x")).select("doc_id", "text_hash", F.explode_outer("x").alias("x")).select("doc_id", "text_hash", "x.start", "x.words")
    return each.join(_small(windows.select("words", "owners")), "words").select("doc_id", "text_hash", "start", F.size("words").alias("length"), "owners")


def matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, start, length, owners: the places of windows of items, and a number for the set of items that hold the window."""
    short, marks, windows = _benchmark(benchmark, span, k, item, item_text)
    return _hits(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), short, marks, windows, span, k).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items (ids as strings, sorted), spans (starts and lengths in words), contaminated."""
    short, marks, windows = _benchmark(benchmark, span, k, item, item_text)
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = _hits(base, short, marks, windows, span, k).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("owners").alias("owners"))
    found, _ = cut(found, "hits")
    owners = windows.groupBy("owners").agg(F.first("items").alias("items"))
    items = found.select("doc_id", "text_hash", F.explode("owners").alias("owners")).join(owners, "owners").groupBy("doc_id", "text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["reach"], x["start"]))).alias("n"), F.greatest(a["reach"], x["start"] + x["length"]).alias("reach")))["n"]
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    got = found.alias("f").join(items.alias("i"), same("f", "i")).select("f.doc_id", "f.text_hash", "spans", "items", covered.alias("n_hit"))
    counted = base.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.alias("d").join(got.alias("g"), same("d", "g"), "left").select("d.doc_id", "d.text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "spans", F.col("n_hit").isNotNull().alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark stands, as they are: rows without text, without a doc_id and repeated rows too;
    rows that share a doc_id are judged each by its own text; columns may have any names."""
    hits = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "text_hash")
    return without(docs, hits, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))}, BROADCAST_ROWS)


_W = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT item_id, {_W.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_W.format("text")} AS w FROM documents),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) AS ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.s = dw.s AND iw.n = dw.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
