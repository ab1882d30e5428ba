"""Each stage on its own input against what it promises."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociflow.llm import decontamination, jaccard, mixing, quality, storage


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs, _ = storage.cut(stage(spark, docs, sf), "test")
    return [*out, docs]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1]) and "shard" in steps[-1].columns
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, sf, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(steps[1]) == ids(quality.score(steps[0], model).filter("kept"))


def test_duplicate_stage(steps):
    from tests.llm.test_operators import brute_components

    want = brute_components([(r["doc_id"], r["text"]) for r in steps[1].collect()], 5, 80)
    assert ids(steps[2]) == {i for i, (_, c) in want.items() if c == i}


def test_decontamination_stage(spark, sf, steps):
    d = decontamination.decontaminate(steps[2], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids(steps[3]) == ids(d.filter("not contaminated"))


def test_mixing_stage(steps):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()} == want


def test_sharding_stage(steps):
    assert steps[5].count() == steps[4].count()
    assert steps[5].groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").isEmpty()


def test_null_and_repeated_ids(spark, sf):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, words(i, 20), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(None, words(100 + i, 20), "en", "b", 1) for i in range(3)] + [(7, words(200 + i, 20), "en", "b", 1) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(df).collect()}
    got = Counter(map(tuple, mixing.stage(spark, df, sf).collect()))
    assert got == Counter({r: copies[r[0], r[3]] for r in rows if copies[r[0], r[3]]}) and any(r[0] is None for r in got)
    again = df.unionByName(df.filter("doc_id is null or doc_id in (3, 7)")).unionByName(df.filter("doc_id is null"))
    assert sorted(map(str, jaccard.stage(spark, again, sf).collect())) == sorted(map(str, df.collect()))


CLASHES = ("_d", "_t", "_h", "_c0_", "_vslot", "vslot", "copies", "row", "h", "n", "size", "keys", "key", "name", "whole", "below", "words", "w", "at", "start", "version")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_columns(spark, sf, name, stage):
    """Nulls, empty and long texts, repeated rows and ids, an empty table, and columns with the names that stages use themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "no id at all", None, None, None), (None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", "a", 0), (1, "another text under the same id", "en", "a", 0), (900_001, "x " * 50_000, "en", "b", None), (900_002, "y" * 60_000, None, "b", None)]
    part = docs.filter("doc_id < 60").unionByName(spark.createDataFrame(odd + odd[:2], docs.schema)).withColumns({c: F.lit(c) for c in CLASHES})
    got = stage(spark, part, sf)
    assert set(part.columns) <= set(got.columns) and len(got.columns) == len(part.columns) + (name == "sharding")
    rows = got.collect()
    assert rows and all(r[c] == c for r in rows for c in CLASHES)
    had = {str((r["doc_id"], r["text"])) for r in part.collect()}
    assert {str((r["doc_id"], r["text"])) for r in rows} <= had
    if name in ("n-gram Jaccard join", "benchmark decontamination", "sharding"):
        assert sum(r["doc_id"] is None for r in rows) == (2 if name == "n-gram Jaccard join" else 4)
    if name == "sharding":
        assert len(rows) == part.count() and {r["shard"] for r in stage(spark, part.withColumn("shard", F.lit(99)), sf).collect()} <= set(range(8))
    assert stage(spark, part.limit(0), sf).count() == 0
