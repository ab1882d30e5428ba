"""The trie of conversation prefixes, by most-significant-digit radix partitioning.

Each distinct turn (role and text) gets a number from a dictionary; a conversation is a row of such numbers. The conversations form one
bucket, the root. A round deals the members of every bucket by the number of their next turn; what it counts for each pair of bucket and
number, in part before the shuffle, is a node of the trie. Buckets that are still large go on to the next round, which reads their members
alone; all others are local: one task sorts such a bucket by multikey quicksort, whose equal parts are the nodes below. Sums over
subtrees are made in the task and then carried up through the large buckets, one level at a time, by joins.

Defined results: a null role or text is empty; turns with the same number are ordered by a hash of role and text, a null turn is the
first; rows without a conv_id are no conversation; repeated rows are turns of their own; an empty table gives an empty result, without
a root; other columns are ignored. A conversation must fit a row, with 12 bytes a turn; the members of a bucket that is local are
bounded by LOCAL_TURNS, or are FEW conversations at most. There are as many rounds as turns that so many conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.sharding import _crc_table
from lociflow.llm.storage import cut, drop

#: A bucket with more turns and more members than these is dealt again.
LOCAL_TURNS, FEW = 50_000, 64
#: Rows of dictionaries and of large buckets up to which they are broadcast; above, joins shuffle and adaptive execution splits hot keys.
BROADCAST_ROWS = 200_000
#: Conversations that follow a common one share up to HEAD - 1 turns with it.
FAMILY, HEAD = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, k1, k2, id, bytes: every turn with its number in the dictionary; texts stay where they are."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(13), text, role).alias("k2"), F.octet_length(text).alias("bytes"))
    turns, _ = cut(keyed, "turns")
    dictionary, _ = cut(turns.select("k1", "k2").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    return turns.join(_small(dictionary), ["k1", "k2"])


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, t (numbers of the turns in order), z (bytes of their texts), family (the conversation whose first turns it may take)."""
    family = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("family")
    lists = family.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k1", "k2", "id", "bytes"))).alias("s"))
    return lists.select("family", "conv_id", F.col("s.id").alias("t"), F.col("s.bytes").alias("z"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """conv_id, t, z where the first turns, up to HEAD - 1, are those of the family's first conversation. A family has FAMILY rows at most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    own = Window.partitionBy("family")
    first = lambda c: F.max(F.when(F.col("conv_id") == F.col("family"), F.slice(c, 1, HEAD - 1))).over(own)
    headed = lists.select("conv_id", "t", "z", first("t").alias("ht"), first("z").alias("hz"))

    def joined(head: str, c: str) -> Column:
        kept = F.slice(c, h + 1, F.greatest(F.size(c), F.lit(1)))
        return F.when(F.col(head).isNull(), kept).otherwise(F.concat(F.slice(head, F.lit(1), h), kept))
    return headed.select("conv_id", joined("ht", "t").alias("t"), joined("hz", "z").alias("z"))


class _Bucket:
    """The members of one local bucket: they share their first `depth` turns."""

    def __init__(self, parent: int, depth: int):
        self.parent, self.depth, self.pieces = parent, depth, []

    def nodes(self) -> dict[str, list]:
        convs = np.concatenate([p[0] for p in self.pieces])
        lengths = np.concatenate([p[1] for p in self.pieces])
        starts = (np.cumsum(lengths) - lengths).tolist()
        t, z = (np.concatenate([p[k] for p in self.pieces]).tolist() for k in (2, 3))
        order = np.argsort(convs, kind="stable").tolist()
        convs, lengths = convs.tolist(), lengths.tolist()
        out: dict[str, list] = {k: [] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
        conv, depths, above, n, kids, leaves, saved, ends = out.values()
        up: list[int] = []
        todo = [(order, self.depth, -1, self.parent)]
        while todo:
            members, depth, parent, name = todo.pop()
            me, least = len(conv), convs[members[0]]
            over = [str(convs[m]) for m in members if lengths[m] == depth]
            conv.append(least), depths.append(depth), above.append(name), n.append(len(members)), up.append(parent)
            saved.append((len(members) - 1) * z[starts[members[0]] + depth - 1])
            ends.append(hashlib.sha256(",".join(over).encode()).hexdigest() if over else NOTHING)
            if len(members) == 1:  # the rest of a single conversation is a chain
                rest = lengths[members[0]] - depth
                if rest:
                    conv += [least] * rest
                    depths += range(depth + 1, depth + rest + 1)
                    above += [least] * rest
                    n += [1] * rest
                    up += range(me, me + rest)
                    saved += [0] * rest
                    ends += [NOTHING] * (rest - 1) + [hashlib.sha256(str(least).encode()).hexdigest()]
                continue
            parts = [[m for m in members if lengths[m] > depth]]
            while parts:
                part = parts.pop()
                if part:
                    pivot = t[starts[part[len(part) // 2]] + depth]
                    less, same, more = [], [], []
                    for m in part:
                        x = t[starts[m] + depth]
                        (same if x == pivot else less if x < pivot else more).append(m)
                    todo.append((same, depth + 1, me, least))
                    parts += [less, more]
        kids += [0] * len(conv)
        leaves += [0] * len(conv)
        for i in range(len(conv) - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            p = up[i]
            if p >= 0:
                kids[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        return out


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of buckets whose rows follow each other."""
    held: dict[str, list] = {}
    bucket, last = None, None

    def flush(most: int) -> Iterator[pa.RecordBatch]:
        if held and len(held["conv_id"]) > most:
            yield pa.record_batch([pa.array(v, pa.string() if k == "ends_sha256" else pa.int64()) for k, v in held.items()], list(held))
            held.clear()

    def close() -> None:
        for k, v in bucket.nodes().items():
            held.setdefault(k, []).extend(v)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "depth", "digit")])
        t, z = batch.column("t"), batch.column("z")
        ends = t.offsets.to_numpy()
        convs, flat_t, flat_z = batch.column("conv_id").to_numpy(), t.values.to_numpy(), z.values.to_numpy()
        z_ends = z.offsets.to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(key[i].tolist())
            if now != last:
                if bucket:
                    close()
                    yield from flush(20_000)
                bucket, last = _Bucket(now[0], now[1] + 1), now
            bucket.pieces.append((convs[i:j], np.diff(ends[i : j + 1]), flat_t[ends[i] : ends[j]], flat_z[z_ends[i] : z_ends[j]]))
    if bucket:
        close()
    yield from flush(0)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, depth, ends_sha256 of rows that come by bucket and block: one running digest, whatever a bucket's size."""
    last, run, out = None, None, []
    for batch in batches:
        for b, d, ids in zip(batch.column("bucket").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (b, d) != last:
                if last:
                    out.append((*last, run.hexdigest()))
                last, run = (b, d), hashlib.sha256(ids.encode())
            else:
                run.update(b"," + ids.encode())
    if last:
        out.append((*last, run.hexdigest()))
    yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string()))], ["bucket", "depth", "ends_sha256"])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def trie(lists: DataFrame) -> DataFrame:
    """All nodes (see NODE) of the sequences conv_id, t, z."""
    spark = lists.sparkSession
    members, _ = cut(lists, "sequences")
    n, least = members.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n:
        return spark.createDataFrame([], NODE)
    members = members.select(F.lit(least).cast("long").alias("bucket"), F.lit(0).alias("depth"), "conv_id", "t", "z")
    level = spark.createDataFrame([(least, 0, None, n, 0)], "conv_id long, depth int, parent_conv_id long, n_convs long, bytes int")
    levels, local, over = [level], [], []
    next_turn = F.get("t", F.col("depth")).alias("digit")
    while True:
        over.append(members.filter(F.size("t") == F.col("depth")).select("bucket", "depth", "conv_id"))
        going = members.filter(F.size("t") > F.col("depth")).select("bucket", "depth", next_turn, "conv_id", "t", "z")
        kids = going.groupBy("bucket", "depth", "digit").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n"), F.max(F.get("z", F.col("depth"))).alias("bytes"), F.sum(F.size("t") - F.col("depth")).alias("turns"))
        large, _ = cut(kids.filter((F.col("turns") > LOCAL_TURNS) & (F.col("n") > FEW)).select("bucket", "depth", "digit", "child", "n", "bytes"), "large")
        if large.isEmpty():
            local.append(going)
            break
        dealt = going.join(_small(large), ["bucket", "depth", "digit"], "left")
        local.append(dealt.filter("child is null").select(*going.columns))
        levels.append(large.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent_conv_id"), F.col("n").alias("n_convs"), "bytes"))
        members, _ = cut(dealt.filter("child is not null").select(F.col("child").alias("bucket"), (F.col("depth") + 1).alias("depth"), "conv_id", "t", "z"), "members")
    spread = _union(local).repartition("bucket", "depth", "digit").sortWithinPartitions("bucket", "depth", "digit")
    low, _ = cut(spread.mapInArrow(_local, NODE), "nodes")
    blocks = _union(over).groupBy("bucket", "depth", F.call_function("shiftright", "conv_id", F.lit(12)).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = blocks.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "block").select("bucket", "depth", "ids").mapInArrow(_digests, "bucket long, depth int, ends_sha256 string")
    ends, _ = cut(ends.select(F.col("bucket").alias("conv_id"), "depth", "ends_sha256"), "ends")
    parts = ["n_children", "n_leaves", "saved_tokens"]
    sums = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    large_nodes = _union(levels).select("conv_id", "depth")
    up, _ = cut(low.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).cast("int").alias("depth"), "n_leaves", "saved_tokens").join(_small(large_nodes), ["conv_id", "depth"], "left_semi").groupBy("conv_id", "depth").agg(*sums), "sums")
    high, below = [], None
    for level in reversed(levels):
        got = up if below is None else up.unionByName(below.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*sums))
        got = got.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in parts])
        made = level.join(got, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
        own = (F.col("n_convs") - 1) * F.col("bytes")
        made = made.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (own + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
        below, _ = cut(made, "level")
        high.append(below)
    return low.unionByName(_union(high).withColumn("depth", F.col("depth").cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(encoded(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


SQL = f"""
WITH RECURSIVE {_crc_table()},
o AS (SELECT conv_id, list(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s, list(octet_length(encode(coalesce(text, ''))) ORDER BY turn NULLS FIRST) AS z FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT conv_id, s, z, list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..')]) AS b FROM o),
h AS (SELECT conv_id, s, z, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[((xor(x, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT % 9 AS h FROM b, tab),
r AS (SELECT h.conv_id, list_concat(coalesce(f.s, [])[:h], h.s[h + 1:]) AS s, list_concat(coalesce(f.z, [])[:h], h.z[h + 1:]) AS z FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, array_to_string(s[:d], '') AS k, CASE WHEN d = 0 THEN 0 ELSE z[d] END AS bytes, len(s) = d AS over FROM (SELECT conv_id, s, z, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256 FROM p GROUP BY k, d),
kids AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT substr(k, 1, 32 * j) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(d + 1)) AS j FROM m) GROUP BY 1)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN sub USING (k) LEFT JOIN m up ON m.d > 0 AND up.d = m.d - 1 AND up.k = substr(m.k, 1, 32 * (m.d - 1))
"""
