"""Spelling variants by full neighbourhoods.

Every word of the vocabulary emits all distinct strings that one deletion, replacement or insertion over the observed alphabet makes
of it; those that are words are its near words, so that no distance is ever computed. Numpy makes the hashes of a block of neighbours
from running sums of the words' own hashes. A bitmap of the vocabulary's hashes, broadcast and of a stated size at most, takes out
most neighbours that are no words; the others become strings and meet the vocabulary by their text. A vocabulary larger than a bitmap
holds is taken in slices of the hash, one pass each.

Words are numbered by falling count and then by code points, so that the least number among a word's near words is its form, and the
way up to a root is a table of pairs of numbers, halved in length by every join.

Defined results: null and empty texts have no words; a null doc_id stands as the empty string in what is hashed; repeated rows count
each time; runs of any length are words like others, and their neighbours are made in blocks of positions; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.native import LOWER, UPPER
from lociflow.llm.sharding import _crc_table
from lociflow.llm.storage import cut, drop

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
#: Words that one bitmap holds (32 bits each), so 32 MB at most; more words take more passes.
PASS_WORDS = 1 << 23
#: Neighbours that are hashed at once, in a task's memory some 60 bytes each.
BLOCK = 1 << 19
#: Code points of words above which a digest stands for a neighbour.
LONG = 64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Multipliers that turn a hash into three places of the bitmap, and one for its slice.
MIXES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of every word of LEAST_LENGTH code points; LEAST_COUNT is left to the caller."""
    run = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    low = run.select("id", F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % MISSPELT == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """Words with an id that rises as n falls and, among equal n, with the code points."""
    return words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n")


def _values(points: np.ndarray) -> np.ndarray:
    """A fixed odd number of 64 bits for each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    for m in MIXES[:2]:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29 + k))) * np.uint64(MIXES[k])) >> np.uint64(64 - bits)


def _slice(h: np.ndarray, passes: int) -> np.ndarray:
    return _place(h, 3, 32) % np.uint64(passes)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of one length, and their code points as a matrix; a matrix holds some BLOCK points."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        step = max(1, BLOCK // int(n))
        for i in range(0, len(same), step):
            rows = same[i : i + step]
            yield rows, np.frombuffer("".join(words[r] for r in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        out = np.zeros(len(words), np.uint64)
        for rows, points in _by_length(words):
            out[rows] = (_values(points) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
        yield pa.record_batch([pa.array(out.view(np.int64))], ["h"])


def _bits(batches: Iterator[pa.RecordBatch], bits: int, passes: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Places in the bitmap of the words of one slice."""
    for batch in _hashes(batches):
        h = batch.column("h").to_numpy().view(np.uint64)
        h = h[_slice(h, passes) == turn]
        yield pa.record_batch([pa.array(np.concatenate([_place(h, k, bits) for k in range(3)]).astype(np.int64))], ["at"])


def _bitmap(vocabulary: DataFrame, bits: int, passes: int, turn: int) -> np.ndarray:
    """At most 2^bits / 64 pairs of numbers come to the driver."""
    got = vocabulary.select("word").mapInArrow(lambda b: _bits(b, bits, passes, turn), "at long")
    got = got.groupBy(F.call_function("shiftright", "at", F.lit(6)).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("x")).toArrow()
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out.view(np.uint8)


def _edits(points: np.ndarray, letters: np.ndarray, known: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind (0 deletion, 1 replacement, 2 insertion), row, position and letter of all distinct neighbours of the rows whose hash is known.
    Equal strings come up once: of equal neighbouring letters the last goes, and a letter is put behind its equals only."""
    m, n = points.shape
    powers, values = _powers(n + 1), _values(letters)
    own = _values(points) * powers[:n]
    before = np.zeros((m, n + 1), np.uint64)
    np.cumsum(own, axis=1, out=before[:, 1:], dtype=np.uint64)
    whole = before[:, -1:]
    last = np.ones((m, n), bool)
    last[:, :-1] = points[:, :-1] != points[:, 1:]
    found = known((before[:, :-1] + (whole - before[:, 1:]) * np.uint64(INVERSE)).ravel())
    r, p = np.divmod(found, n)
    keep = last[r, p]
    yield 0, r[keep], p[keep], p[keep]
    width = max(1, BLOCK // (m * len(letters)))
    for kind, places in ((1, n), (2, n + 1)):
        start = whole - own if kind == 1 else before + (whole - before) * np.uint64(BASE)
        for first in range(0, places, width):
            part = start[:, first : first + width]
            new = powers[first : first + part.shape[1], None] * values[None, :]
            found = known((part[:, :, None] + new[None]).ravel())
            r, rest = np.divmod(found, part.shape[1] * len(letters))
            p, x = np.divmod(rest, len(letters))
            p += first
            keep = (p == n) | (points[r, np.minimum(p, n - 1)] != letters[x])
            yield kind, r[keep], p[keep], x[keep]


def _key(word: str) -> str:
    """What stands for a word where neighbours meet the vocabulary: itself, or the digest of a long one."""
    return word if len(word) <= LONG else "#" + hashlib.md5(word.encode()).hexdigest()


def _neighbours(batches: Iterator[pa.RecordBatch], alphabet: str, bitmap, bits: int, passes: int, turn: int) -> Iterator[pa.RecordBatch]:
    """near, id: a neighbour that may be a word, and the number of the word it was made of."""
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    table = bitmap.value

    def known(h: np.ndarray) -> np.ndarray:
        found = None
        for k in range(3):
            at = _place(h if found is None else h[found], k, bits)
            hit = np.flatnonzero((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            found = hit if found is None else found[hit]
        return found if passes == 1 else found[_slice(h[found], passes) == turn]

    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        for rows, every in _by_length(words):
            step = max(1, BLOCK // (every.shape[1] * len(letters)))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                for kind, r, p, x in _edits(every[i : i + step], letters, known):
                    skip = 0 if kind == 2 else 1
                    put = [""] * len(r) if kind == 0 else [alphabet[j] for j in x.tolist()]
                    for j in range(0, len(r), 1 << 16):
                        near = [_key(words[a][:b] + c + words[a][b + skip :]) for a, b, c in zip(own[r[j : j + (1 << 16)]].tolist(), p[j : j + (1 << 16)].tolist(), put[j : j + (1 << 16)], strict=True)]
                        yield pa.record_batch([pa.array(near, pa.string()), pa.array(ids[own[r[j : j + (1 << 16)]]])], ["near", "id"])


def neighbours(vocabulary: DataFrame, size: int) -> DataFrame:
    """key, n_near, best: how many words of the vocabulary (id, word; `size` rows) are one edit away, and the least of their ids."""
    spark = vocabulary.sparkSession
    alphabet = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()))  # the letters of LETTERS at most
    passes = max(1, -(-size // PASS_WORDS))
    bits = max(10, (32 * -(-size // passes) - 1).bit_length())
    parts = max(spark.sparkContext.defaultParallelism * 4, size // 50_000)
    spread = vocabulary.select("word", "id").repartition(parts, F.xxhash64("word"))
    near = None
    for turn in range(passes):
        bitmap = spark.sparkContext.broadcast(_bitmap(vocabulary, bits, passes, turn))
        one = spread.mapInArrow(lambda b, bitmap=bitmap, turn=turn: _neighbours(b, alphabet, bitmap, bits, passes, turn), "near string, id long")
        near = one if near is None else near.unionByName(one)
    return near.groupBy(F.col("near").alias("key")).agg(F.count(F.lit(1)).alias("n_near"), F.min("id").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """id, root of every link (id, form), where no way up returns: each round every link takes its form's link, so that ways halve."""
    spark = links.sparkSession
    now, path = cut(links.select("id", F.col("form").alias("root")), "ways")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("after"))
        then, new = cut(now.join(ahead, "root", "left").select("id", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "ways")
        moved = not then.filter("moved").isEmpty()
        drop(spark, path)
        now, path = then.select("id", "root"), new
        if not moved:
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    counted, at = cut(word_counts(docs, key, text).filter(F.col("n") >= LEAST_COUNT), "words")
    vocabulary, _ = cut(numbered(counted), "vocabulary")
    drop(docs.sparkSession, at)
    near = neighbours(vocabulary, vocabulary.count())
    of = vocabulary.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    fits = F.col("form_n") >= 2 * F.col("n")
    keyed = vocabulary.withColumn("key", F.when(F.length("word") > LONG, F.concat(F.lit("#"), F.md5("word"))).otherwise(F.col("word")))
    linked, _ = cut(keyed.join(near, "key", "left").join(of, "best", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("up"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    tops = roots(linked.filter(F.col("up").isNotNull()).select("id", F.col("up").alias("form")))
    named = tops.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("top")), "root").select("id", "top")
    return linked.join(named, "id", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE {_crc_table()},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
o AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= 5 GROUP BY doc_id, w),
b AS (SELECT w, k, list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(hex(encode(doc_id || ':' || w)), '..')]) AS b FROM o),
h AS (SELECT w, k, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[((xor(x, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM b, tab),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
holes AS (SELECT word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, z.word AS other FROM holes a JOIN holes z ON a.hole = z.hole AND a.word <> z.word
         UNION ALL SELECT c.word, v.word FROM cuts c JOIN v ON v.word = c.less
         UNION ALL SELECT v.word, c.word FROM cuts c JOIN v ON v.word = c.less),
best AS (SELECT near.word, count(*) AS n_near, first(v.word ORDER BY v.n DESC, v.word) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = near.other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END::BIGINT AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL
"""
