"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.native import free_names, named

_own: dict[str, str] = {}
#: Least and most bits of the bitmap of only(), as powers of two: eight for each id, 16 MB at most.
FILTER_BITS = (16, 27)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), one of our own that goes with the process."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lociflow-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def cut(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Writes df as Parquet and reads it again: later plans start there. Returns the frame and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lociflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables written by cut()."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _bits(n: int) -> int:
    return min(max((8 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def without(rows: DataFrame, ids: DataFrame, keys: dict[str, Column], most: int) -> DataFrame:
    """The rows for which no row of ids has the same keys (a column of ids, and what it is in rows; nulls are equal). Up to `most` ids are
    broadcast. With more, a bitmap of their hashes is: rows that it doesn't know pass as they are, and only the others move."""
    names = free_names(rows, len(keys) + 2)
    own, word, bits = names[: len(keys)], names[-2], names[-1]
    ids, _ = cut(ids.select(*[F.col(c).alias(n) for c, n in zip(keys, own, strict=True)]).distinct(), "ids")
    on = None
    for c, n in zip(keys.values(), own, strict=True):
        on = c.eqNullSafe(F.col(n)) if on is None else on & c.eqNullSafe(F.col(n))
    n = ids.count()
    if n <= most:
        return rows.join(F.broadcast(ids), on, "left_anti")
    place = lambda cols: F.pmod(F.xxhash64(F.lit(5), *cols), F.lit(1 << _bits(n)))
    bit = lambda cols: F.call_function("shiftleft", F.lit(1).cast("long"), (place(cols) % 64).cast("int"))
    words = ids.groupBy(F.floor(place(map(F.col, own)) / 64).alias(word)).agg(F.bit_or(bit(map(F.col, own))).alias(bits))
    marked = rows.withColumn(word, F.floor(place(keys.values()) / 64)).join(F.broadcast(words), word, "left")
    known = F.coalesce(F.col(bits).bitwiseAND(bit(keys.values())) != 0, F.lit(False))
    columns = [named(c) for c in rows.columns]
    return marked.filter(~known).select(*columns).unionByName(marked.filter(known).select(*columns).join(ids, on, "left_anti"))


def sieved(rows: DataFrame, at: Column, hashes: DataFrame, flag: str) -> DataFrame:
    """The rows with a boolean column `flag`: false where the hash `at` is surely none of those in the only column of `hashes`. A bitmap
    of bounded size for any input is broadcast; nothing else moves."""
    word, bits, own = free_names(rows, 3)
    hashes = hashes.toDF(own)
    n = _bits(hashes.count())
    place = lambda h: F.pmod(h, F.lit(1 << n))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (place(h) % 64).cast("int"))
    words = hashes.groupBy(F.floor(place(F.col(own)) / 64).alias(word)).agg(F.bit_or(bit(F.col(own))).alias(bits))
    met = rows.withColumn(word, F.floor(place(at) / 64)).join(F.broadcast(words), word, "left")
    return met.select(*[named(c) for c in rows.columns], F.coalesce(F.col(bits).bitwiseAND(bit(at)) != 0, F.lit(False)).alias(flag))


def only(rows: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = 0) -> DataFrame:
    """The rows whose key is in ids, nulls in neither. Up to `most` ids are broadcast. Of more, a bitmap of hashed ids, of bounded
    size for any input, is broadcast and drops most other rows before the join, so that these don't move."""
    ids = ids.select(key).distinct()
    n = ids.count()
    if n <= most:
        return rows.join(F.broadcast(ids), key, "left_semi")
    at = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << _bits(n)))
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    words = ids.select(at.alias("_at")).groupBy(F.floor(F.col("_at") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_at", at).withColumn("_word", F.floor(F.col("_at") / 64))
    near = marked.join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).select(*map(named, rows.columns))
    return near.join(ids, key, "left_semi")
