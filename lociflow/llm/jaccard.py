"""N-gram Jaccard join, size-aware, with its connected components.

A document's set holds its distinct k-word shingles as 64-bit hashes. Documents with equal sets form a class; the class's
least id stands for it, and only representatives are joined.

Small sets: for every size of a partner the least overlap c is known; all subsets of c shingles are enumerated on both
sides, and sets that share one are candidates. Large sets (and small ones that may have large partners): inverted lists
of the first shingles of each set in one global order, as many as must hold a common one if two sets link; the lists are
scanned. The boundary between small and large minimizes the cost of both over the sizes found in the data.

The global order puts frequent shingles last, so that shared passages do not make long lists: first those that a table of
2^20 counters over all documents shows to be frequent; then also all that two different sets list under that order, kept in a
bitmap of 64 MB at most. Sets that list no such shingle link with nothing and are left out. Lists that stay long belong to large groups of near copies. Their members are
dealt into chunks of bounded size, twice with other salts; in a chunk, the components are found by scanning inverted
lists and leaving out members that have been reached, which is linear where copies are close. What remains is made exact:
members that are not in the main component of one of their lists are sent to all chunks that may hold partners of theirs.
No step makes all pairs of a group, caps partners or drops candidates.

Links are decided on whole sets: 100 * intersection >= percent * union.

Defined results: null and empty texts and texts without words have empty sets, link with nothing and are components of
their own; a text of fewer than k words has its whole word sequence as one shingle; rows with the same doc_id are one
node; rows with a null doc_id link with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.llm import bytescan as bs
from lociflow.llm import storage
from lociflow.llm.components import components
from lociflow.llm.native import free_names, named
from lociflow.llm.storage import cut, drop, only, without

COUNTER_BITS = 20
#: Share of the range of hashes, from 0, that counters cover: first shingles of a set of some size have small hashes.
COUNTED = 0.2
SMALL_MOST = 32
#: What a listed shingle costs beside an enumerated subset: it is shuffled twice, counted, joined and scanned.
SCAN_COST = 8
#: Members up to which a list's pairs are candidates as they are.
LIST_MOST = 24
#: Size of a chunk: a text counts its shingles, or a sixteenth of its bytes where that is more.
CHUNK = 300_000
#: Members from which a list is hot: joins on its key bring the other side to its rows instead of its rows to one task.
HOT = 2_000
#: Rows of the other side up to which that is done by a broadcast.
HOT_ROWS = 200_000
SHARED_BITS = (20, 29)
#: Hashes of repeated rows up to which they are broadcast.
BROADCAST_HASHES = 100_000
U = np.uint64


def least_overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m shingles that links them."""
    return -(-percent * (n + m) // (100 + percent))


def counter_of(s: np.ndarray) -> np.ndarray:
    """The counter of each shingle; one past the last for hashes that none covers."""
    return np.minimum((s >> U(64 - COUNTER_BITS - 8)).astype(np.float64) / 256 / COUNTED, float(1 << COUNTER_BITS)).astype(np.int64)


def list_length(n: int, percent: int) -> int:
    """First shingles of which linked sets share one."""
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int, boundary: int) -> list[int]:
    """Sizes of the subsets of a set of n that meet small partners; equal sets are one class and need none."""
    return sorted({c for m in partner_sizes(n, percent) if 0 < m <= boundary and (c := least_overlap(n, m, percent)) <= min(n, m) and not (m == n and c == n)})


def boundary_by_cost(sizes: dict[int, int], percent: int) -> int:
    """The size up to which sets count as small: the one of least total cost for the sets found."""
    def cost(x: int) -> int:
        total = 0
        for n, count in sizes.items():
            if n <= x:
                total += count * sum(comb(n, c) for c in subset_sizes(n, percent, x))
            if n > x or 100 * n // percent > x:
                total += count * list_length(n, percent) * SCAN_COST
        return total

    return min(range(SMALL_MOST + 1), key=lambda x: (cost(x), x))


def set_keys(s: np.ndarray, lv: np.ndarray, percent: int, boundary: int) -> np.ndarray:
    """Keys of a sorted set: subsets where it is small, first shingles (by lv, then hash) where it may have a large partner."""
    n, out = len(s), []
    if n <= boundary:
        with np.errstate(over="ignore"):
            own = bs.mix(s)
            total = own.sum(dtype=U)
            for c in subset_sizes(n, percent, boundary):
                gone = list(combinations(range(n), n - c))
                less = own[np.array(gone, np.int64)].sum(1, dtype=U) if n > c else np.zeros(1, U)
                out.append(bs.mix((total - less) ^ (U(c) * U(0x9E3779B97F4A7C15))))
    if n > boundary or 100 * n // percent > boundary:
        p = list_length(n, percent)
        out.append(s[:p] if not lv.any() else s[np.argsort(lv, kind="stable")[:p]])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def _counted(docs: DataFrame, k: int) -> DataFrame:
    """i, n: counters of shingles by their first bits, and after them counters of set sizes up to SMALL_MOST."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << COUNTER_BITS) + SMALL_MOST + 2, np.int64)
        for batch in (x for whole in batches for x in bs.pieces(whole)):
            sets = list(bs.shingle_sets(batch.column("text"), k))
            if sets:
                at = counter_of(np.concatenate(sets))
                total[: 1 << COUNTER_BITS] += np.bincount(at[at < 1 << COUNTER_BITS], minlength=1 << COUNTER_BITS)
                sizes = np.array([len(s) for s in sets])
                total[(1 << COUNTER_BITS) + 1 :] += np.bincount(sizes[sizes <= SMALL_MOST], minlength=SMALL_MOST + 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

    return docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """0 for counters that hold what chance gives, then one more for each doubling."""
    mean = counts.mean()
    usual = mean + 6 * np.sqrt(mean) + 4
    return np.where(counts > usual, np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0).astype(np.int8)


class Order:
    """The global order of shingles: shared ones (by a bitmap of 2^bits hashed keys) and frequent ones (by counters) come last."""

    def __init__(self, levels: np.ndarray, boundary: int, percent: int, shared: np.ndarray | None = None, bits: int = 0) -> None:
        self.levels, self.boundary, self.percent, self.shared, self.bits = levels, boundary, percent, shared, bits

    def is_shared(self, keys: np.ndarray) -> np.ndarray:
        low = keys & U((1 << self.bits) - 1)
        return (self.shared[(low >> U(6)).astype(np.int64)] >> (low & U(63))) & U(1) != 0

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set. With a bitmap: none unless the keys of the order without it hold a shared one, since sets that link
        share a key in either order."""
        if not len(s):
            return s
        lv = self.levels[counter_of(s)]
        first = set_keys(s, lv, self.percent, self.boundary)
        if self.shared is None:
            return first
        if not self.is_shared(first).any():
            return s[:0]
        return set_keys(s, lv + self.is_shared(s), self.percent, self.boundary)


def first_order(docs: DataFrame, k: int, percent: int) -> Order:
    counts = np.zeros((1 << COUNTER_BITS) + SMALL_MOST + 2, np.int64)
    got = _counted(docs, k).toArrow()  # as many rows as counters, whatever the input
    counts[got["i"].to_numpy()] = got["n"].to_numpy()
    levels = np.append(frequency_levels(counts[: 1 << COUNTER_BITS]), np.int8(0))
    return Order(levels, boundary_by_cost({i: int(c) for i, c in enumerate(counts[(1 << COUNTER_BITS) + 1 :]) if i and c}, percent), percent)


def second_order(first: Order, signed: DataFrame) -> Order:
    """The order that also puts behind all keys which two different sets have in the first one."""
    total = signed.agg(F.sum(F.size("keys"))).first()[0] or 1
    bits = min(max(int(8 * total).bit_length(), SHARED_BITS[0]), SHARED_BITS[1])
    low = F.expr(f"key & {(1 << bits) - 1}L")
    keys = signed.select("f1", F.explode("keys").alias("key")).groupBy("key").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).filter("a <> b").select(low.alias("low"))
    words = keys.groupBy(F.shiftright("low", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("bits")).toArrow()  # a bitmap of bounded size
    shared = np.zeros(1 << (bits - 6), U)
    shared[words["w"].to_numpy()] = words["bits"].to_numpy().view(U)
    return Order(first.levels, first.boundary, first.percent, shared, bits)


def signatures(docs: DataFrame, k: int, order: Order) -> DataFrame:
    """doc_id, n, size (what the text counts in a chunk), f1, f2 (of the set), keys."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in (x for whole in batches for x in bs.pieces(whole)):
            n, f1, f2, keys = [], [], [], []
            with np.errstate(over="ignore"):
                for s in bs.shingle_sets(batch.column("text"), k):
                    n.append(len(s))
                    f1.append(int(bs.mix(s).sum(dtype=U).view(np.int64)))
                    f2.append(int(bs.mix(s ^ U(0xD1B54A32D192ED03)).sum(dtype=U).view(np.int64)))
                    keys.append(own.keys(s).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            size = np.maximum(np.array(n, np.int64), pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 16)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(size), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "n", "size", "f1", "f2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n int, size long, f1 long, f2 long, keys array<long>")


class Lists:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        self.shingles, token = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")
        self.members = owner[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.shingles)))])

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which sets link with s."""
        at = np.searchsorted(self.shingles, s)
        there = np.flatnonzero(at < len(self.shingles))
        hit = at[there][self.shingles[at[there]] == s[there]]
        if not len(hit):
            return np.zeros(0, np.int64)
        lists = [self.members[a:b] for a, b in zip(self.first[hit].tolist(), self.first[hit + 1].tolist(), strict=True)]
        both = np.bincount(np.concatenate(lists), minlength=len(self.size))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + self.size - both)))


def chunk_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The first member of each member's component, by breadth-first search over inverted lists."""
    lists, n = Lists(sets), len(sets)
    label = np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root], queue = root, [root]
        while queue and (label < 0).any():
            new = lists.linked(sets[queue.pop()], percent)
            new = new[label[new] < 0]
            label[new] = root
            queue.extend(new.tolist())
    return label


def _edges(a: list, b: list, kind: pa.DataType) -> pa.Table:
    return pa.table([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def _dealt(homes: DataFrame, salt: int) -> DataFrame:
    return homes.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("chunks")).cast("int"))


def spread(rows: DataFrame, other: DataFrame, hot_keys: DataFrame, few: bool) -> DataFrame:
    """rows joined with other on key. What other has of hot keys is broadcast, as long as that is few rows, so that the many rows of a hot
    key stay where they are; all other keys meet in a shuffle."""
    if not few:
        return rows.join(other, "key")
    there = other.join(F.broadcast(hot_keys), "key", "left_semi")
    if there.count() > HOT_ROWS:
        return rows.join(other, "key")
    cold = rows.join(F.broadcast(hot_keys), "key", "left_anti").join(other.join(F.broadcast(hot_keys), "key", "left_anti"), "key")
    return cold.unionByName(rows.join(F.broadcast(there), "key"))


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int, made: list[str]) -> DataFrame:
    """a, b: links between representatives, as many as connect every component. reps: doc_id, n, size, keys. Paths of the tables that the
    result reads are added to made."""
    def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        table, path = storage.cut(df, name)
        made.append(path)
        return table, path

    kind = dict(docs.dtypes)["doc_id"]
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    entries = reps.select("doc_id", "n", "size", F.explode("keys").alias("key"))
    lists, _ = cut(entries.groupBy("key").count().filter("count > 1"), "keys")
    hot_keys = lists.filter(F.col("count") > HOT).select("key")
    few = hot_keys.count() <= HOT_ROWS
    multi, _ = cut(spread(entries, lists, hot_keys, few), "lists")
    texts, _ = cut(only(docs.select("doc_id", "text"), multi.select("doc_id").distinct()), "texts")  # all that later joins move
    hot = multi.filter(F.col("count") > LIST_MOST)
    homes0 = hot.groupBy("doc_id").agg(F.max("size").alias("size"), F.max(F.struct("count", "key"))["key"].alias("home"))
    per_home = homes0.groupBy("home").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    homes, _ = cut(homes0.join(per_home, "home"), "homes")

    def in_chunk(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_pylist()
        label = chunk_components(list(bs.shingle_sets(table["text"], k)), percent)
        pairs = [(ids[i], ids[j]) for i, j in enumerate(label.tolist()) if i != j]
        return _edges([x for x, _ in pairs], [y for _, y in pairs], id_type)

    near = None
    for salt in (1, 2):
        own = texts.join(_dealt(homes, salt), "doc_id").select("home", "chunk", "doc_id", "text")
        found = own.groupBy("home", "chunk").applyInArrow(in_chunk, f"a {kind}, b {kind}")
        near = found if near is None else near.unionByName(found)
    near, _ = cut(near, "near")
    groups, _ = cut(components(near), "groups")

    # what the chunks may have missed: members outside the main component of a long list, against all who share one
    known = hot.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    of_list = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = of_list.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component"))["component"].alias("main")).filter("parts > 1")
    mixed, _ = cut(mixed.select("key", "main"), "mixed")
    guests, _ = cut(spread(known, mixed, hot_keys, few).filter("component <> main").select("doc_id", "component", "key", "size").distinct(), "guests")
    key_homes, _ = cut(spread(hot.select("doc_id", "key").join(homes.select("doc_id", "home", "chunks"), "doc_id"), mixed.select("key"), hot_keys, few).select("key", "home", "chunks").distinct(), "key_homes")
    visits, _ = cut(spread(guests, key_homes, hot_keys, few).select("doc_id", "component", "size", "home", "chunks").distinct(), "visits")
    halls = visits.groupBy("home").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("halls"))
    hosts = _dealt(homes, 1).join(halls, "home").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).withColumn("hall", F.explode(F.sequence(F.lit(0), F.col("halls") - 1))).select("doc_id", "component", "home", "chunk", "hall", F.lit(False).alias("guest"))
    come = visits.join(halls, "home").withColumn("hall", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("halls")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("doc_id", "component", "home", "chunk", "hall", F.lit(True).alias("guest"))

    def in_hall(table: pa.Table) -> pa.Table:
        guest = table["guest"].to_numpy()
        sets = list(bs.shingle_sets(table["text"], k))
        ids, comps = table["doc_id"].to_pylist(), table["component"].to_pylist()
        at = np.flatnonzero(~guest).tolist()
        there, a, b = Lists([sets[i] for i in at]), [], []
        for g in np.flatnonzero(guest).tolist():
            seen = {comps[g]}
            for j in there.linked(sets[g], percent).tolist():
                if comps[at[j]] not in seen:
                    seen.add(comps[at[j]])
                    a.append(ids[g])
                    b.append(ids[at[j]])
        return _edges(a, b, id_type)

    far = texts.join(hosts.unionByName(come), "doc_id").select("home", "chunk", "hall", "doc_id", "text", "component", "guest").groupBy("home", "chunk", "hall").applyInArrow(in_hall, f"a {kind}, b {kind}")

    # short lists: their pairs, unless one component holds both already
    short = multi.filter(F.col("count") <= LIST_MOST)
    left = short.select("key", F.col("doc_id").alias("a"), F.col("n").alias("na"))
    right = short.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b").distinct()
    comp = groups.select(F.col("id"), F.col("component"))
    pairs = pairs.join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = bs.shingle_sets(batch.column("ta"), k), bs.shingle_sets(batch.column("tb"), k)
            ok = []
            for s, t in zip(x, y, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_texts = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    plain = with_texts.mapInArrow(holds, f"a {kind}, b {kind}")
    return near.unionByName(far).unionByName(plain)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id of an equal set; null if empty), component_id. One row for each row of docs."""
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    order = first_order(base, k, percent)
    sig, _ = cut(signatures(base, k, order), "signatures")
    some = sig.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    copies = some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    member, _ = cut(some.select("doc_id", "f1", "f2", "n").join(copies, ["f1", "f2", "n"]).select("doc_id", "class_id").distinct(), "members")
    again = signatures(base, k, second_order(order, some)).filter((F.size("keys") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n", "size", "keys")
    reps, reps_path = cut(again.join(member.filter("doc_id <> class_id"), "doc_id", "left_anti"), "reps")
    made = [reps_path]
    found, found_path = cut(links(base, reps, k, percent, made), "links")
    comp, _ = cut(components(found), "components")
    drop(base.sparkSession, *made, found_path)
    by_class = member.join(comp.select(F.col("id").alias("class_id"), F.col("component").alias("c")), "class_id", "left").select("doc_id", "class_id", F.coalesce("c", "class_id").alias("component"))
    alone = comp.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), "component").join(member.select("doc_id"), "doc_id", "left_anti")
    known = by_class.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component").alias("component"))
    return sig.select("doc_id", "n").join(known, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM (SELECT doc_id, string_agg(s, '|' ORDER BY s) AS s FROM g GROUP BY doc_id)),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, class_id, least(w.doc_id, coalesce(m.least_, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_ FROM r GROUP BY doc_id) m USING (doc_id)
"""


def once(docs: DataFrame) -> DataFrame:
    """One row of each set of equal rows. Only rows whose hash comes again are compared and moved."""
    own, same = free_names(docs, 2)
    # maps are compared by their sorted entries
    values = [F.array_sort(F.map_entries(named(f.name))) if isinstance(f.dataType, T.MapType) else named(f.name) for f in docs.schema]
    h = F.xxhash64(*values)
    again, _ = cut(docs.select(h.alias(own)).groupBy(own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own), "again")
    n = again.count()
    if not n:
        return docs
    small, marked = F.broadcast(again) if n <= BROADCAST_HASHES else again, docs.withColumn(own, h)
    columns = [named(c) for c in docs.columns]
    repeated = marked.join(small, own, "left_semi").withColumn(same, F.struct(*values)).dropDuplicates([same])
    return marked.join(small, own, "left_anti").select(*columns).unionByName(repeated.select(*columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one of the least doc_id. Documents without words stay, and so do those without a doc_id;
    of equal rows, with or without a doc_id, one stays; rows that share a doc_id but differ go or stay together; columns may have any names."""
    docs = once(docs)
    gone = near_duplicates(docs, k, percent).filter("component_id <> doc_id").select("doc_id")
    return without(docs, gone, {"doc_id": F.col("doc_id")}, HOT_ROWS)
