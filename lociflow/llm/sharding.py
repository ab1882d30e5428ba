"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes and rows are summed per slot (a table whose size
is the number of slots, whatever the input), and a versioned map sends each slot to a shard. Rebalancing
edits the map and leaves all slots that need not move where they are; the records are never hashed anew.

Defined results: a null or empty text has size 1; a record hashes by its id and its text, so that rows without an
id or with the same one go apart; rows that are equal in both share a slot and are placed in turn and each keeps a place of its own; an empty table gives an
empty result and an empty map; other columns of the input are ignored by `place` and kept by `write_shards`.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.native import free_names, md5_bits, named, row_key
from lociflow.llm.storage import shared_dir

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Slot -> shard. `version` counts edits; `moved` has the slots that the last edit moved."""

    shard: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @property
    def shards(self) -> int:
        return max(self.shard, default=-1) + 1

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, s, self.version) for i, s in enumerate(self.shard)], "vslot int, shard int, version int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path; earlier versions stay readable, and a version that is written again is replaced."""
        self.frame(spark).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        df = spark.read.parquet(path)
        v = version if version is not None else df.agg(F.max("version")).first()[0]
        rows = df.filter(F.col("version") == v).orderBy("vslot").collect()  # as many as there are slots
        if not rows or [r["vslot"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"{path} holds no whole map of version {v}")
        return SlotMap(tuple(r["shard"] for r in rows), v)


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    return (md5_bits(row_key(key, text), "slot", 8) % slots).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes (none for null) and one for the record's end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_sizes(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot: at most `slots` rows reach the driver."""
    got = docs.select(virtual_slot(F.col(key), F.col(text), slots).alias("vslot"), text_size(F.col(text)).alias("size")).groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    return {r["vslot"]: (r["b"], r["n"]) for r in got.collect()}


def balanced_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
    """Largest slot first, each to the shard that has least. Empty slots go round the shards."""
    heap = [(0, s) for s in range(shards)]
    out = [i % shards for i in range(slots)]
    for slot in sorted(sizes, key=lambda s: (-sizes[s][0], s)):
        have, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (have + sizes[slot][0], s))
    return SlotMap(tuple(out))


def rebalance(old: SlotMap, sizes: dict[int, tuple[int, int]], shards: int, slack: float = 0.02) -> SlotMap:
    """A new version of the map for `shards` shards: slots leave shards that are over the mean by more than slack
    (or that no longer exist), and go to those that have least. All other slots stay."""
    total = sum(b for b, _ in sizes.values())
    most = total / shards * (1 + slack)
    load, out, spare = [0] * shards, list(old.shard), []
    for slot, s in enumerate(old.shard):
        if s < shards:
            load[s] += sizes.get(slot, (0, 0))[0]
        else:
            spare.append(slot)
    by_shard: dict[int, list[int]] = {}
    for slot, s in enumerate(old.shard):
        if s < shards and slot in sizes:
            by_shard.setdefault(s, []).append(slot)
    for s, own in by_shard.items():
        for slot in sorted(own, key=lambda x: (sizes[x][0], x)):
            b = sizes[slot][0]
            if load[s] <= most:
                break
            if load[s] - b >= total / shards * (1 - slack):
                load[s] -= b
                spare.append(slot)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(spare, key=lambda x: (-sizes.get(x, (0, 0))[0], x)):
        have, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (have + sizes.get(slot, (0, 0))[0], s))
    moved = tuple(i for i, (a, b) in enumerate(zip(old.shard, out, strict=True)) if a != b)
    return SlotMap(tuple(out), old.version + 1, moved)


def place(docs: DataFrame, mapping: SlotMap, sizes: dict[int, tuple[int, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds vslot, size, shard and slot: the place in its shard, without gaps from 0.

    A slot's rows are numbered where they meet; the slots of a shard follow each other, so that a slot's first
    place is the sum of rows of the slots before it. No task sees more than one slot's keys at a time."""
    slots = len(mapping.shard)
    first, have = [0] * slots, [0] * max(mapping.shards, 1)
    for i, s in enumerate(mapping.shard):
        first[i] = have[s]
        have[s] += sizes.get(i, (0, 0))[1]
    own = Window.partitionBy("vslot").orderBy(F.col(key).asc_nulls_last(), "crc", "size")
    base = docs.select(F.col(key).alias("doc_id"), text_size(F.col(text)).alias("size"), F.crc32(F.coalesce(F.encode(F.col(text), "utf-8"), F.encode(F.lit(""), "utf-8"))).alias("crc"), virtual_slot(F.col(key), F.col(text), slots).alias("vslot"))
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, s, first[i]) for i, s in enumerate(mapping.shard)], "vslot int, shard int, first long")
    numbered = base.withColumn("n", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(table), "vslot").select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"), "vslot", F.lit(mapping.version).alias("map_version"))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, SlotMap]:
    """Slots, sizes, a balanced map, and every record's place."""
    sizes = slot_sizes(docs, slots, key, text)
    mapping = balanced_map(sizes, shards, slots)
    return place(docs, mapping, sizes, key, text), mapping


def stored_map(spark: SparkSession, sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
    """A balanced map, written to the shared folder as version 1 and read back: what places records is the stored table."""
    path = f"{shared_dir(spark)}/lociflow/slots-{uuid.uuid4().hex}"
    balanced_map(sizes, shards, slots).save(spark, path)
    return SlotMap.load(spark, path)


def with_shard(docs: DataFrame, mapping: SlotMap, key: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """docs with its shard as a column `name`, without a shuffle. Where docs has such a column already, that one is replaced."""
    at, own = free_names(docs, 2)
    table = mapping.frame(docs.sparkSession).select(F.col("vslot").alias(at), F.col("shard").alias(own))
    got = docs.withColumn(at, virtual_slot(F.col(key), F.col(text), len(mapping.shard))).join(F.broadcast(table), at)
    return got.select(*[named(c) for c in docs.columns if c.lower() != name.lower()], F.col(own).alias(name))


def write_shards(docs: DataFrame, mapping: SlotMap, path: str, key: str = "doc_id", text: str = "text", files_per_shard: int = 8) -> None:
    """One folder for each shard; every shard's slots are dealt over files_per_shard tasks."""
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(21)), F.lit(files_per_shard))
    with_shard(docs, mapping, key, text).repartition(mapping.shards * files_per_shard, "shard", spread).write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = slot_sizes(docs)
    placed = place(docs, stored_map(spark, sizes, 8), sizes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: int = 8) -> DataFrame:
    """The documents with their shard. Rows without a doc_id, or with the same one, are told apart by their texts; a column named shard is
    replaced, other columns stay as they are."""
    return with_shard(docs, stored_map(spark, slot_sizes(docs), shards))


def _crc_table() -> str:
    """The public table of CRC-32 (polynomial 0xEDB88320), made in SQL bit by bit."""
    steps = ["c0 AS (SELECT i, i::UBIGINT AS c FROM range(256) AS r(i))"] + [f"c{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k})" for k in range(8)]
    return ", ".join(steps) + ", tab AS (SELECT list(c ORDER BY i) AS t FROM c8)"


SQL = f"""
WITH RECURSIVE {_crc_table()},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, (('0x' || substr(md5('slot:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT % {SLOTS})::INT AS v, list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]) AS b FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[((xor(x, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, tab),
sz AS (SELECT v, sum(size)::BIGINT AS b, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, v) AS k FROM d GROUP BY v),
g AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS have, NULL::INT AS v, NULL::INT AS shard
      UNION ALL SELECT sz.k, [have[i] + CASE WHEN i = list_position(have, list_min(have)) THEN sz.b ELSE 0 END FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]], sz.v, (list_position(have, list_min(have)) - 1)::INT FROM g JOIN sz ON sz.k = g.k + 1),
m AS (SELECT g.v, g.shard, coalesce(sum(sz.n) OVER (PARTITION BY g.shard ORDER BY g.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_ FROM g JOIN sz USING (v))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (first_ + row_number() OVER (PARTITION BY v ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM d JOIN crc USING (doc_id) JOIN m USING (v)
"""
