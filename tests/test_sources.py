"""Files over several splits, sequences, the cache of results, the index of hits, and groups of samples."""

import pytest
from pyspark.sql import functions as F

from lociflow.operators import homologs
from lociflow.sources import readers, writers
from lociflow.sources.cache import Cache


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_over_splits(spark, tmp_path, small_splits):
    for name, n in (("b.txt", 150), ("a.txt", 7), ("c.txt", 0), ("d.txt", 60)):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" if i % 3 else "\n" for i in range(n)))
    t = readers.lines(spark, str(tmp_path))
    assert t.rdd.getNumPartitions() > 3 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    got = {(r["_file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in t.collect()}
    assert got == {(name, i): f"{name} {i}" if i % 3 else "" for name, n in (("b.txt", 150), ("a.txt", 7), ("d.txt", 60)) for i in range(n)}


@pytest.mark.parametrize("block", [10_000, 4])
def test_fasta_over_splits(spark, tmp_path, small_splits, monkeypatch, block):
    """Records of many lines, > inside lines, empty records, two files, lines before the first header."""
    monkeypatch.setattr(readers, "LINES", block)
    want = []
    for name, first in (("x.fa", "; a comment\nACGT\n"), ("y.fa", "")):
        text = first
        for i in range(30):
            seq = "ACGTN-"[i % 6] * (i * 7)
            head = f"{name}_{i}" + (" to>there" if i % 2 else ">b>c")
            want.append((len(want), head.split()[0], seq))
            text += f">{head}\n" + "".join(f"{seq[k:k + 11]} \n" for k in range(0, len(seq), 11)) + ("\n" if i % 4 == 0 else "")
        (tmp_path / name).write_text(text)
    assert sorted(tuple(r) for r in readers.fasta(spark, str(tmp_path)).collect()) == want


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "ACGT" * 40), ("b", ""), ("c", "A"), ("d", "G" * 60), ("e", "T" * 61)]
    writers.write_fasta(spark.createDataFrame(rows, "name string, seq string"), str(tmp_path / "f"))
    assert sorted((r["name"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "f")).collect()) == rows


def test_cache_computes_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([(f"chr{c}", i, c * 100 + i) for c in range(1, 5) for i in range(3)], "chrom string, pos long, v long")
    calls = []

    def compute(own):
        calls.append(own)
        return rows.filter(F.col("chrom").isin(own))

    cache = Cache(spark, str(tmp_path / "cache"))
    assert cache.read(3, "all") is None
    assert cache.get(3, "all", ["chr1", "chr2"], compute).count() == 6
    got = cache.get(3, "all", ["chr2", "chr3", "chr4"], compute)
    assert calls == [["chr1", "chr2"], ["chr3", "chr4"]]
    assert {(r["chrom"], r["since"]) for r in got.collect()} == {("chr2", 1), ("chr3", 2), ("chr4", 2)}
    assert cache.get(3, "all", ["chr1"], compute).count() == 3 and len(calls) == 2
    # another K is a cache of its own; rows are replaced by chromosome; columns may come later
    assert cache.get(4, "all", ["chr1"], compute).count() == 3 and calls[-1] == ["chr1"]
    cache.put(rows.filter("chrom = 'chr1'").select("chrom", "pos", (F.col("v") + 1).alias("v"), F.lit("new").alias("note")), 3, "all")
    now = {(r["chrom"], r["pos"]): (r["v"], r["note"]) for r in cache.read(3, "all").collect()}
    assert now["chr1", 0] == (101, "new") and now["chr2", 0] == (200, None) and len(now) == 12
    assert {r["v"] for r in cache.read(3, "all", ["chr1"], version=1).collect()} == {100, 101, 102}


def test_cache_survives_an_unfinished_call(spark, tmp_path):
    rows = spark.createDataFrame([("chr1", 1)], "chrom string, v long")
    cache = Cache(spark, str(tmp_path / "cache"))
    cache.put(rows, 2, "all")
    (tmp_path / "cache" / "manifest" / "version=2").mkdir()
    (tmp_path / "cache" / "manifest" / "version=2" / "part-0.parquet").write_text("half")
    rows.write.parquet(str(tmp_path / "cache" / "data" / "lost"))
    assert cache.read(2, "all").count() == 1 and len(cache.entries()) == 1


def test_index_opens_few_files(spark, tmp_path):
    hits = spark.range(4000).select(F.format_string("g%04d", (F.col("id") / 2).cast("int")).alias("query"), F.concat(F.lit("t"), "id").alias("target"), (F.col("id") % 7).cast("double").alias("bitscore"), F.lit(0.5).alias("identity"), F.lit("diamond").alias("source_type"), F.col("id").cast("string").alias("hit_id"))
    path = str(tmp_path / "index")
    homologs.write_index(hits, path, 8)
    genes = spark.createDataFrame([("g0003",), ("g0004",), ("none",), ("g0003",)], "query string")
    assert len(homologs.files_of(spark, path, spark.createDataFrame([("g0003",), ("g0004",)], "query string"))) == 1
    assert homologs.files_of(spark, path, spark.createDataFrame([("zzz",)], "query string")) == []
    got = homologs.lookup_many(spark, path, genes, 1).orderBy("query")
    assert [(r["query"], r["found"], r["n_hits_total"], r["n_hits_emitted"], r["hit_id"]) for r in got.collect()] == [("g0003", True, 2, 1, "6"), ("g0004", True, 2, 1, "9" if 9 % 7 > 8 % 7 else "8"), ("none", False, 0, 0, None)]
    read = set()
    for f in homologs.lookup_many(spark, path, genes, 1).inputFiles():
        read.add(f)
    assert len([f for f in read if "/data/" in f]) <= 2
    assert homologs.lookup_many(spark, path, spark.createDataFrame([("zzz",)], "query string")).first()["found"] is False


def test_groups_by_strategy(spark):
    registry = spark.createDataFrame([("mine", "a"), ("inv_1_chr1_HET", "a"), ("inv_1_chr1_HOM_INV", "b"), ("inv_2_chr2_HET", "c"), ("ancestry_K3_Q1", "a"), ("ancestry_K3_Q2", "b")], "group string, sample_id string")
    values = spark.createDataFrame([("chr1", "a", 0.1), ("chr1", "b", 0.12), ("chr1", "c", 0.9), ("chr1", "d", 2.0), ("chr1", "e", None), ("chr2", "a", 1.0)], "chrom string, sample_id string, value double")
    q = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.1, 0.9])], "sample_id string, q array<double>")
    g = homologs.Groups(spark, registry, values=values, q=q)
    of = lambda *a, **k: sorted(tuple(r) for r in g.resolve(*a, **k).select("group", "sample_id").collect())
    assert of({"x": ["a", "b"]}) == [("x", "a"), ("x", "b")]
    assert of("mine, inv_2_chr2_HET") == [("inv_2_chr2_HET", "c"), ("mine", "a")]
    assert of("inv_*") == [("inv_1_chr1_HET", "a"), ("inv_1_chr1_HOM_INV", "b"), ("inv_2_chr2_HET", "c")]
    assert of("precomp_bands", "chr1") == [("band1", "a"), ("band1", "b"), ("band2", "c"), ("band3", "d")]
    assert of("precomp_bands", "chr2") == [("band1", "a")]
    assert of("C01i_decomposition", "chr1") == [("inv_1_chr1_HET", "a"), ("inv_1_chr1_HOM_INV", "b")]
    assert of("ancestry_clusters") == [("Q1", "a"), ("Q2", "b")]
    bare = homologs.Groups(spark, registry.filter("group = 'mine'"), q=q)
    assert sorted(tuple(r) for r in bare.resolve("ancestry_clusters").collect()) == [("Q1", "a"), ("Q2", "b")]
    with pytest.raises(ValueError):
        g.resolve("unknown")


def test_wide_round_trip(spark, tmp_path):
    rows = [("a", 10, "x y", 1.5), ("a", 9, "z", None), ("a", 9, "x y", 2.0), ("b", 1, "é", -0.25), ("b", 1, None, 7.0)]
    df = spark.createDataFrame(rows, "part string, at long, who string, much double")
    path = str(tmp_path / "wide")
    writers.write_wide(df, path, "part", "at", "who", "much", compression="gzip")
    got = readers.wide(spark, path, "part", "at", "who", "much").collect()
    cells = {(p, str(a), w): "NA" for p, a in (("a", 9), ("a", 10), ("b", 1)) for w in ("x y", "z", "é")}
    cells |= {(p, str(a), w): str(v) for p, a, w, v in rows if w is not None and v is not None}
    assert len(got) == len(cells) and {tuple(r)[:3]: r["much"] for r in got} == cells
    text = spark.read.text(f"{path}/part=a").collect()
    assert [r[0].split("\t")[0] for r in text] == ["at", "9", "10"]
    writers.write_wide(df.limit(0), str(tmp_path / "none"), "part", "at", "who", "much")
    assert not list((tmp_path / "none").glob("part=*"))


def test_index_grows_by_files(spark, tmp_path):
    """A file of an index holds about as many hits as asked, however many hits there are."""
    hits = spark.range(4000).select(F.format_string("g%04d", (F.col("id") / 2).cast("int")).alias("query"), F.concat(F.lit("t"), "id").alias("target"), F.lit(1.0).alias("bitscore"), F.lit(0.5).alias("identity"), F.lit("diamond").alias("source_type"), F.col("id").cast("string").alias("hit_id"))
    path = str(tmp_path / "index")
    homologs.write_index(hits, path, 4, 200)
    sizes = [r["n_hits"] for r in spark.read.parquet(path + "/manifest").collect()]
    assert sum(sizes) == 4000 and len(sizes) == 20 and max(sizes) < 400


def test_fasta_sorts_no_lines(spark, tmp_path, capsys):
    """Lines are joined as they are read: only pieces of records are shuffled, no window sees lines."""
    writers.write_fasta(spark.createDataFrame([("a", "ACGT" * 40)], "name string, seq string"), str(tmp_path / "f"))
    t = readers.fasta(spark, str(tmp_path / "f"))
    t.explain()
    plan = capsys.readouterr().out
    assert "row_number" not in plan and plan.count("PythonMapInArrow") + plan.count("MapInArrow") >= 1
    assert not [x for x in plan.splitlines() if "Window" in x and "value" in x]
