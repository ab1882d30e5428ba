"""Closed forms and properties, independent of the SQL."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import expr
from lociflow.operators import ancestry, codons, homologs, popstats, relations, scan, windows
from lociflow.plans import adapters, dispatch
from lociflow.sources import readers, writers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("x", [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 5.0])
def test_erfc(spark, x):
    assert one(spark, expr.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=2e-7)


def test_distances(spark):
    assert one(spark, expr.jc69(F.lit(0.3))) == pytest.approx(-0.75 * math.log(1 - 0.4))
    assert one(spark, expr.jc69(F.lit(0.8))) == math.inf
    assert one(spark, expr.jc69(F.lit(-0.1))) is None
    assert one(spark, expr.k80(F.lit(0.1), F.lit(0.05))) == pytest.approx(-0.5 * math.log(0.75) - 0.25 * math.log(0.9))


def test_codon_tables():
    assert codons.AMINO["ATG"] == "M" and codons.AMINO["TGG"] == "W" and [c for c in codons.CODONS if codons.AMINO[c] == "*"] == ["TAA", "TAG", "TGA"]
    assert codons.synonymous_sites("GGG") == 1 and codons.synonymous_sites("ATG") == 0
    assert codons.synonymous_sites("TTT") == pytest.approx(1 / 3)
    assert codons.fourfold("GCA") and not codons.fourfold("ATA")
    assert codons.substitutions("TTT", "TTC") == (1, 0, 0, 0) and codons.substitutions("TTT", "TTA") == (0, 0, 0, 1)
    for a in codons.CODONS[::7]:
        for b in codons.CODONS[::5]:
            n = sum(x != y for x, y in zip(a, b))
            total = sum(codons.substitutions(a, b))
            assert total == pytest.approx(0 if "*" in (codons.AMINO[a], codons.AMINO[b]) else n) or total == 0


def test_codon_pairs(spark):
    df = spark.createDataFrame([("same", "ATGGCC", "ATGGCC"), ("syn", "GGGGGG", "GGAGGG"), ("gap", "AT-GCC", "ATGGCC"), ("odd", "ATG", "ATGA")], "pair_id string, seq_a string, seq_b string")
    r = {x["pair_id"]: x for x in codons.pair_statistics(df).collect()}
    assert set(r) == {"same", "syn", "gap"}
    assert r["same"]["sd"] == 0 and r["same"]["dS"] == 0
    assert r["syn"]["sd"] == 1 and r["syn"]["pS"] == 0.5 and r["syn"]["nd"] == 0
    assert r["gap"]["n_codons_gap"] == 1 and r["gap"]["n_codons_used"] == 1


def _gl(spark, calls):
    """Hard calls: {pos: [genotype of each sample]}."""
    rows = [("chr1", p, i, float(g == 0), float(g == 1), float(g == 2)) for p, gs in calls.items() for i, g in enumerate(gs)]
    return spark.createDataFrame(rows, "chrom string, pos long, sample_idx int, gl0 double, gl1 double, gl2 double")


def _groups(spark):
    return spark.createDataFrame([("A", 0), ("A", 1), ("A", 2), ("B", 3), ("B", 4), ("B", 5)], "group string, sample_idx int")


def test_fixed_differences(spark):
    d = popstats.dosages(_gl(spark, {p: [0, 0, 0, 2, 2, 2] for p in range(1, 8)}))
    r = popstats.pairwise_divergence(popstats.group_frequencies(d, _groups(spark)), 100, 100).first()
    assert (r["FST"], r["dXY"], r["dA"], r["MInorm"]) == (1, 1, 1, pytest.approx(1))
    c = popstats.cohort_diversity(popstats.site_frequencies(d), 100, 100).first()
    assert c["theta_pi"] == pytest.approx(0.5 * 6 / 5) and c["S"] == 7
    a1 = sum(1 / k for k in range(1, 6))
    assert c["theta_W"] == pytest.approx(1 / a1)


def test_few_sites_are_zero(spark):
    d = popstats.dosages(_gl(spark, {p: [0, 1, 2, 2, 1, 0] for p in (1, 2)}))
    assert popstats.cohort_diversity(popstats.site_frequencies(d), 100, 100).first()["theta_pi"] == 0


def test_introgression_signs(spark):
    pops = spark.createDataFrame([("P1", 0), ("P2", 1), ("P3", 2), ("O", 3)], "group string, sample_idx int")
    for calls, want in (([0, 2, 2, 0], 1), ([2, 0, 2, 0], -1)):
        t = relations.introgression_terms(relations.population_frequencies(popstats.dosages(_gl(spark, {p: calls for p in (1, 2, 3)})), pops))
        r = relations.introgression(t, 100, 100).first()
        assert r["D"] == want and r["fdM"] == want


def test_ranks(spark):
    v = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 9.0]
    r = popstats.ranked(spark.createDataFrame([(x,) for x in v], "fis double")).collect()
    assert sorted(x["rank"] for x in r) == [1, 2.5, 2.5, 5, 5, 5, 7]


def test_rank_sums_add_up(spark):
    rows = [("a", float(i % 5), i < 7) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, v double, inside boolean")
    flip = df.withColumn("inside", ~F.col("inside"))
    u = [scan.two_sided_tests(x, ["k"]).first()["U"] for x in (df, flip)]
    assert sum(u) == 7 * 13


def test_merge_gap(spark):
    rows = [("c", 1, 10, 1.0, 1), ("c", 10_010, 10_020, 1.0, 1), ("c", 20_022, 20_030, 1.0, 1), ("c", 20_025, 90_000, 1.0, 1), ("c", 95_000, 96_000, 1.0, 1)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, stat double, n_variants long")
    r = scan.regions(df, 10_000).orderBy("start").collect()
    assert [(x["start"], x["end"], x["n_windows"]) for x in r] == [(1, 10_020, 2), (20_022, 96_000, 3)]
    counts = [scan.regions(df, g).count() for g in (0, 5_000, 10_000, 100_000)]
    assert counts == sorted(counts, reverse=True)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 2, 9, 7, 3]], "v double")
    s = sorted([5, 1, 1, 2, 9, 7, 3])
    for q in (0, 0.1, 0.5, 0.95, 1):
        assert scan.percentile_at(df, "v", q).first()["cut"] == s[int(q * 6)]
        assert scan.percentile_at(df, "v", q, half=True).first()["cut"] == s[int(q * 6 + 0.5)]


def test_bootstrap_of_constant(spark):
    df = spark.createDataFrame([("a", i, 3.0) for i in range(9)], "k string, i int, v double")
    r = scan.bootstrap(df, ["k"], ["i"], replicates=20).first()
    assert (r["observed"], r["boot_mean"], r["ci_low"], r["ci_high"], r["boot_sd"]) == (3, 3, 3, 3, 0)


def test_queries_resample_by_default(spark, sf, monkeypatch):
    from lociflow.plans import codons as codon_plans
    from lociflow.plans import tracks

    seen = []
    monkeypatch.setattr(codon_plans.co, "codon_bootstrap", lambda df, by, replicates=1000: seen.append(replicates) or df.select(*by))
    codon_plans.QUERIES["codon_bootstrap"](spark, sf)
    monkeypatch.setattr(tracks.scan, "candidates_against_flanks", lambda *a, permutations, **k: seen.append(permutations) or a[0])
    tracks.QUERIES["scan_permutation_test"](spark, sf)
    assert seen == [1000, 1000]


def test_nearest_gene(spark):
    g = spark.createDataFrame([("c", 100, 200, "g1", 1), ("c", 400, 500, "g2", 2), ("c", 150, 160, "g3", 3)], "chrom string, start long, end long, gene_id string, ord long")
    r = spark.createDataFrame([("c", 1, 290, 310), ("c", 2, 140, 170), ("c", 3, 800, 810), ("d", 4, 1, 2), ("c", 5, 0, 2)], "chrom string, region int, start long, end long")
    got = {x["region"]: (x["nearest_gene"], x["gene_distance"]) for x in windows.nearest(r, g, ["chrom", "region"]).collect()}
    assert got == {1: ("g1", 100), 2: ("g1", 0), 3: ("g2", 305), 4: (None, None), 5: ("g1", 99)}


def test_overlap_join_each_pair_once(spark):
    a = spark.createDataFrame([("c", 0, 1000, "x"), ("c", 5000, 5000, "y")], "chrom string, start long, end long, a string")
    b = spark.createDataFrame([("c", 500, 3000, "p"), ("c", 1000, 1001, "q"), ("c", 5001, 6000, "r")], "chrom string, start long, end long, b string")
    assert sorted((r["a"], r["b_r"]) for r in windows.overlap_join(a, b, 100).collect()) == [("x", "p"), ("x", "q")]
    assert sorted((r["a"], r["b_r"]) for r in windows.overlap_join(a, b, 100, strict=True).collect()) == [("x", "p")]


def test_em_recovers_ancestry():
    r = np.random.default_rng(0)
    f = np.stack([r.uniform(0.05, 0.3, 200), r.uniform(0.7, 0.95, 200)], 1)
    true = np.array([[1, 0]] * 5 + [[0, 1]] * 5, float)
    geno = r.binomial(2, f @ true.T)
    g = np.eye(3)[geno] * 0.98 + 0.01
    q, trace = ancestry.em_proportions(g, f, np.full((10, 2), 0.5), 50)
    assert np.allclose(q.sum(1), 1) and (q.argmax(1) == true.argmax(1)).all()
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))


def test_ehh_of_identical_haplotypes():
    pos = np.arange(0, 5) * 100
    g = np.zeros((5, 4, 3))
    g[..., 0] = 1
    assert relations.ehh_walk(pos, g, 2) == pytest.approx(400)


def test_ehh_focal_sites(spark, sf):
    from lociflow import registry

    rows = [("c", p, i, 0.9, 0.06, 0.04) for p in range(300, 12300, 400) for i in range(4)]
    gl = spark.createDataFrame(rows, "chrom string, pos long, sample_idx int, gl0 double, gl1 double, gl2 double")
    at = lambda every: sorted(r["pos"] for r in relations.xp_ehh(gl, [0, 1], [2, 3], every, smallest=2).collect())
    assert at(1) == list(range(300, 12300, 400)) and at(7) == list(range(300, 12300, 2800))
    sites = {(r["chrom"], r["pos"]) for r in adapters.gl(spark, sf).select("chrom", "pos").distinct().collect()}
    assert {(r["chrom"], r["pos"]) for r in registry.queries()["rel_xp_ehh"](spark, sf).collect()} == sites


def test_structure_classes(spark):
    seqs = {"few": "ab", "same": "aaaa", "dom": "aaaaaaaaab", "two": "aaaabbbb", "frag": "abcabcabcabc", "grad": "aaaaaabbbbbccc"}
    rows = [(k, i, x) for k, s in seqs.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "s string, i int, label string")
    got = {r["s"]: r["structure_class"] for r in ancestry.composition(df, ["s"], ["i"], min_rows=1).collect()}
    assert got == {"few": "too_sparse", "same": "homogeneous", "dom": "dominant_plus_secondary", "two": "two_block_composite", "frag": "multi_block_fragmented", "grad": "continuous_gradient"}


def test_readers(spark, tmp_path):
    p = tmp_path / "gl.beagle"
    p.write_text("marker\tallele1\tallele2\ts0_0\ts0_1\ts0_2\ts1_0\ts1_1\ts1_2\nchr_1_100\t0\t2\t.8\t.15\t.05\t0\t0\t0\nchr_1_200\tA\tT\t2\t1\t1\t1\tx\t1\n")
    r = readers.beagle(spark, str(p), normalise=True).orderBy("site_idx", "sample_idx").collect()
    assert [(x["chrom"], x["pos"], x["sample_id"], x["site_idx"]) for x in r] == [("chr_1", 100, "s0", 0), ("chr_1", 100, "s1", 0), ("chr_1", 200, "s0", 1), ("chr_1", 200, "s1", 1)]
    assert r[2]["gl0"] == 0.5 and r[0]["allele2"] == "G" and r[3]["gl1"] is None
    assert readers.beagle(spark, str(p), start=150).first()["site_idx"] == 1
    t = tmp_path / "t.tsv"
    t.write_text("# schema_version=2 n=5\nChr\twin_start\twin_end\tFst_A_B\tn_snps\nc\t1\t10\tNA\t3\nc\t1\t10\nc\t11\t20\t0.5\t4\n")
    assert [tuple(x) for x in readers.track(spark, str(t)).collect()] == [("c", 1, 10, None, 3), ("c", 11, 20, 0.5, 4)]
    assert readers.metadata(spark, str(t)) == {"schema_version": "2", "n": "5"} and readers.tsv_dropped(spark, str(t)) == 1
    f = tmp_path / "x.fa"
    f.write_text(">a_A x\nAT\nG\n>a_B\nATC\n>c\nA\n")
    assert [tuple(x) for x in readers.fasta_pairs(spark, str(f)).collect()] == [("a", "ATG", "ATC")]
    h = tmp_path / "h.paf"
    h.write_text("q\t9\t0\t9\t+\tt\t99\t5\t14\t6\t9\t60\tms:i:42\nq\t9\t0\t9\t-\tt\t99\t5\t14\t3\t9\t60\n")
    assert [x["bitscore"] for x in readers.paf(spark, str(h)).collect()] == [42, -1]
    assert readers.shell_config('export A=1\nB="${A}/x"\nC=${D:-y}') == {"A": "1", "B": "1/x", "C": "y"}
    s = tmp_path / "s.txt"
    s.write_text("/x/S1.sorted.markdup.bam\nS2.cram\n")
    assert [x["sample_id"] for x in readers.sample_list(spark, str(s)).orderBy("sample_idx").collect()] == ["S1", "S2"]


def test_cache_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "chrom string, v double")
    path = str(tmp_path / "cache")
    writers.write_cache(df, path, 8, "all")
    writers.write_cache(df.filter("chrom = 'c1'").withColumn("v", F.lit(9.0)), path, 8, "all")
    assert {r["chrom"]: r["v"] for r in writers.read_cache(spark, path, 8, "all").collect()} == {"c1": 9, "c2": 2}
    assert writers.read_cache(spark, path, 8, "other", "c2").first()["v"] == 2 and writers.read_cache(spark, path, 3, "all").isEmpty()
    up = writers.upsert(df, df.filter("chrom = 'c2'").withColumn("v", F.lit(5.0)), ["chrom"])
    assert {r["chrom"]: r["v"] for r in up.collect()} == {"c1": 1, "c2": 5}


def test_requests(spark):
    track = spark.createDataFrame([("c", 0, 99, 0.5, 3), ("c", 100, 199, 0.1, 3)], "chrom string, start long, end long, stat double, n_variants long")
    ok = json.loads(dispatch.answer(spark, json.dumps({"statistic": "outlier_scan", "request_id": "r", "params": {"threshold": 0.25}}), {"track": track}))
    assert ok["status"] == "ok" and ok["rows"][0]["strong"] and ok["request_id"] == "r"
    assert json.loads(dispatch.answer(spark, '{"statistic": "outlier_scan", "params": {"threshold": 2}}', {"track": track}))["status"] == "empty"
    assert json.loads(dispatch.answer(spark, '{"statistic": "nope"}', {}))["status"] == "error"
    assert json.loads(dispatch.answer(spark, "{", {}))["status"] == "error"


def test_region_request(spark):
    gl = _gl(spark, {p: [0, 0, 1, 2, 2, 1] for p in range(1, 9)})
    r = dispatch.region_stats(gl, "chr1", 1, 100, ["theta_pi", "Fst", "Hobs"], _groups(spark)).first()
    assert r["n_sites"] == 8 and 0 < r["Fst"]["A_B"] < 1
    with pytest.raises(ValueError):
        dispatch.region_stats(gl, "chr1", 1, 100, ["nope"])


def test_lookup(spark):
    h = spark.createDataFrame([("g", "t1", "diamond", 0.9, 50.0, "1"), ("g", "g", "diamond", 1.0, 99.0, "2"), ("g", "t2", "miniprot", 0.8, -1.0, "3")], "query string, target string, source_type string, identity double, bitscore double, hit_id string")
    r = homologs.lookup(h, "g", 1)
    assert (r["found"], r["n_hits_total"], r["n_hits_emitted"], r["hits"][0]["target"]) == (True, 3, 1, "g")
    assert homologs.lookup(h, "g", 0)["n_hits_emitted"] == 0 and not homologs.lookup(h, "x")["found"]
    assert [x["target"] for x in homologs.paralogs(h).collect()] == ["t1"]


def test_streaming(spark, sf, tmp_path):
    from lociflow.streaming.positions import windowed

    src = spark.read.parquet(f"{sf}/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == windowed(src).count() > 0


def test_segment_and_names(spark):
    from lociflow.functions import expr

    df = spark.createDataFrame([(m,) for m in (5, 10, 14, 15, 20, 21, 25, 26)], "m long")
    got = [r[0] for r in df.select(expr.segment(F.col("m"), F.lit(10), F.lit(20))).collect()]
    assert got == ["Left flank", "Inv. left half", "Inv. left half", "Core", "Core", "Inv. right half", "Inv. right half", "Right flank"]
    assert expr.common_columns(["a", "b", "c"], ["c", "a", "d"]) == ["a", "c"]
    assert [round(r[0], 6) for r in spark.range(0, 100, 99).select(expr.log10_1p(F.col("id"))).collect()] == [0.0, 2.0]


def test_numbers_and_medians_by_blocks(spark):
    import numpy as np
    from lociflow.operators import scan, windows

    r = np.random.default_rng(3)
    pos = sorted({int(x) for x in r.integers(0, 9_000_000, 500)})
    df = spark.createDataFrame([("c1", p) for p in pos] + [("c2", p) for p in pos[:7]], "chrom string, pos long").repartition(5)
    got = {(x["chrom"], x["pos"]): (x["_i"], x["_n"]) for x in windows.numbered(df, ["pos"]).collect()}
    assert got == {**{("c1", p): (i, len(pos)) for i, p in enumerate(pos)}, **{("c2", p): (i, 7) for i, p in enumerate(pos[:7])}}
    for n in (1, 2, 501, 1000):
        v = [float(x) for x in r.integers(0, 40, n)]
        assert scan.whole_median(spark.createDataFrame([(x,) for x in v], "v double"), "v") == float(np.median(v))
    assert scan.whole_median(spark.createDataFrame([], "v double"), "v") is None


def test_codon_bootstrap_intervals(spark):
    """Intervals of the drawn ratios hold the whole ratio and shrink with the number of codons."""
    import numpy as np
    from lociflow.operators import codons as co

    r = np.random.default_rng(8)
    rows = [(g, i, 0.7, float(x), float(y), 1.0, float(x), 1.0, float(y)) for g, n in ((1, 200), (2, 5000)) for i, (x, y) in enumerate(r.random((n, 2)))]
    df = spark.createDataFrame(rows, "locus long, codon_no long, s double, sd double, nd double, n4 double, d4 double, n0 double, d0 double")
    got = {x["locus"]: x for x in co.codon_bootstrap(df, ["locus"], 400).collect()}
    for g in (1, 2):
        own = [x for x in rows if x[0] == g]
        whole = sum(x[3] for x in own) / sum(x[2] for x in own)
        assert got[g]["pi_S_lo"] < whole < got[g]["pi_S_hi"]
    assert got[2]["pi_S_hi"] - got[2]["pi_S_lo"] < 0.4 * (got[1]["pi_S_hi"] - got[1]["pi_S_lo"])
    again = {x["locus"]: x for x in co.codon_bootstrap(df.repartition(7), ["locus"], 400).collect()}
    assert all(abs(again[g][c] - got[g][c]) < 1e-9 for g in got for c in ("pi_S_lo", "pi_N_hi", "pi_4_lo", "pi_0_hi"))


def test_documents_with_a_path(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "a long, b double")
    doc = json.loads(writers.write_document(df, str(tmp_path / "d"), "x", "r1", {"n": 2}))
    assert doc["status"] == "ok" and doc["meta"] == {"n": 2}
    assert sorted((r["a"], r["b"]) for r in spark.read.json(doc["rows_path"]).collect()) == [(1, None), (2, 0.5)]
    assert json.loads(writers.write_document(df.limit(0), str(tmp_path / "e"), "x"))["status"] == "empty"
    monkeypatch.setattr(writers, "MOST_ROWS", 1)
    with pytest.raises(ValueError):
        writers.document(df, "x")


def test_means_in_order_of_rows(spark):
    """Means between two roundings: added in the rows' order on any partitioning, and rounded as SQL does."""
    rng = np.random.default_rng(5)
    values = np.round(rng.random((4000, 64)) * 120, 2)
    values = values[np.rint(values * 100).sum(axis=1).astype(np.int64) * 100 % 64 == 32]
    want = {}
    for i, v in enumerate(values.tolist()):
        total = 0.0
        for x in v:
            total += x
        want[i] = math.floor(total / 64 * 10_000 + 0.5) / 10_000
    rows = [(i, j, "a", x) for j in reversed(range(64)) for i, x in enumerate(values[:, j].tolist())]
    df = spark.createDataFrame(rows, "s int, i int, label string, v double").repartition(7)
    got = {r["s"]: r["mean_v"] for r in ancestry.composition(df, ["s"], ["i"], numbers=["v"]).collect()}
    assert len(got) > 20 and got == want


def test_scan_summary_without_regions(spark):
    track = spark.createDataFrame([("a", 0, 9, 1.0, 3)], "chrom string, start long, end long, stat double, n_variants long")
    none = track.filter("stat > 2")
    r = scan.scan_summary(track, none, scan.regions(none), 100).first()
    assert (r["n_windows"], r["n_outlier_windows"], r["n_regions"], r["n_strong"], r["strong_bp"]) == (1, 0, 0, 0, 0)
    assert r["outlier_bp"] is None and r["outlier_percent"] is None


def test_ld_of_sites_of_little_variance(spark):
    """Sites with a great mean and little variance keep their places; equal r^2 of two groups goes to the first name; seams lose no pair."""
    rng = np.random.default_rng(2)
    pos = np.arange(1, 400) * 37
    d = {p: 1.7 + rng.random(7) * 1e-4 for p in pos.tolist()}
    for p in pos[::3].tolist():
        d[p][[0, 1, 3, 4]] = 0.1  # one sample of each group differs: r^2 is 1 in both
        d[p][[2, 5]] = rng.random(2)
    dos = spark.createDataFrame([("c", p, i, float(x)) for p, v in d.items() for i, x in enumerate(v) if i < 6], "chrom string, pos long, sample_idx int, dosage double")
    groups = spark.createDataFrame([("A", i) for i in (0, 1, 2)] + [("B", i) for i in (3, 4, 5)], "group string, sample_idx int")
    pairs = relations.ld_pairs(dos, groups, 200).cache()
    got = {(r["group"], r["pos_a"], r["pos_b"]): r["r2"] for r in pairs.collect()}
    exact = lambda p, s: [__import__("fractions").Fraction(float(d[p][i])) for i in s]
    want = {}
    for g, s in (("A", (0, 1, 2)), ("B", (3, 4, 5))):
        for p in pos.tolist():
            for q in [q for q in pos.tolist() if p < q <= p + 200]:
                x, y = ([v - sum(z) / 3 for v in z] for z in (exact(p, s), exact(q, s)))
                qx, qy = sum(a * a for a in x), sum(b * b for b in y)
                want[g, p, q] = float(sum(a * b for a, b in zip(x, y)) ** 2 / (qx * qy)) if min(qx, qy) > 1e-12 else 0.0
    assert set(got) == set(want)
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9
    top = {(r["pos_a"], r["pos_b"]): r["dominant_group"] for r in relations.ld_decomposition(pairs).collect()}
    tied = [(p, q) for g, p, q in want if g == "A" and (p // 37 - 1) % 3 == (q // 37 - 1) % 3 == 0]
    assert len(tied) > 50 and all(top[k] == "A" for k in tied)
    span = relations.ld_span(dos, 200).first()
    assert (span["lo"], span["hi"]) == (min(p for _, p, _ in want), max(q for _, _, q in want))


def test_codon_pairs_make_no_rows(spark, capsys):
    """Codons are counted where sequences lie; letters outside ASCII, lower case, U, stops, gaps and tails as before; repeated ids add up."""
    rows = [(1, "ATGuuuTAA--GCé", "ATGTTCTAAA-GCA"), (1, "AAACCCGGGTTTAA", "AAGCCAGGATTCAA"), (2, "AC", "GT"), (3, "AAA", "AA"), (4, None, "AAA")]
    df = spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string")
    got = codons.pair_statistics(df)
    r = {x["pair_id"]: x for x in got.collect()}
    assert set(r) == {1, 2}
    assert (r[1]["n_bp"], r[1]["n_codons_total"], r[1]["n_codons_gap"], r[1]["n_codons_stop"], r[1]["n_codons_used"]) == (14, 8, 1, 1, 6)
    assert (r[2]["n_codons_total"], r[2]["S"], r[2]["pS"]) == (0, 0.0, None)
    assert r[1]["n_4d_sites"] == 2 and r[1]["n_4d_diffs"] == 2 and r[1]["sd"] == 5
    got.explain()
    assert "Generate" not in capsys.readouterr().out
