"""Block-wise scans with carried seams and EHH with shared pair products, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators import relations, scan, windows
from lociflow.plans import adapters as ad


@pytest.mark.parametrize("block", [50, 1_000, 10**6])
def test_merged_regions(spark, block):
    """One window over a chromosome gives the same regions; long windows reach over many blocks, empty blocks lie between."""
    r = np.random.default_rng(3)
    rows = [(f"c{int(r.integers(0, 3))}", int(s), int(s + (r.integers(1, 60) if r.random() < 0.95 else 900)), 1.0) for s in np.concatenate([r.integers(0, 5_000, 150), r.integers(20_000, 22_000, 60)])]
    df = spark.createDataFrame(rows + rows[:5], "chrom string, start long, end long, stat double")
    w = Window.partitionBy("chrom").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    plain = df.withColumn("n", F.when(before.isNull() | (F.col("start") - before > 20), 1).otherwise(0)).withColumn("region", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("n")
    assert sorted(map(tuple, scan.merged(df, 20, block).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("block", [70, 100_000])
def test_nearest_genes(spark, block):
    r = np.random.default_rng(4)
    genes = [(f"c{int(r.integers(0, 3))}", int(s), int(s + r.integers(0, 40)), f"g{i}", i) for i, s in enumerate(r.integers(0, 4_000, 80))] + [("c0", 50, 60, "tie1", 100), ("c0", 50, 60, "tie2", 99)]
    regions = [(f"c{int(r.integers(0, 4))}", int(i), int(s), int(s + r.integers(0, 90))) for i, s in enumerate(r.integers(0, 6_000, 120))]
    got = windows.nearest(spark.createDataFrame(regions, "chrom string, region long, start long, end long"), spark.createDataFrame(genes, "chrom string, start long, end long, gene_id string, ord long"), ["chrom", "region"], block).collect()
    want = {}
    for c, i, s, e in regions:
        mid = (s + e) // 2
        found = min(((0 if a <= mid <= b else a - mid if mid < a else mid - b, o, g) for k, a, b, g, o in genes if k == c), default=None)
        want[c, i] = (found[2], found[0]) if found else (None, None)
    assert len(got) == len(regions) and {(x["chrom"], x["region"]): (x["nearest_gene"], x["gene_distance"]) for x in got} == want


def sites_of(spark, sf):
    """chrom -> positions and genotypes of a whole table."""
    rows = ad.gl(spark, sf).orderBy("chrom", "pos", "sample_idx").toPandas()
    g = rows[["gl0", "gl1", "gl2"]].to_numpy()
    rows[["gl0", "gl1", "gl2"]] = (g / g.sum(axis=1, keepdims=True)).astype(np.float32)
    out = {}
    for c, x in rows.groupby("chrom"):
        out[c] = (np.sort(x["pos"].unique()), x[["gl0", "gl1", "gl2"]].to_numpy().astype(float).reshape(-1, ad.SAMPLES, 3))
    return out


@pytest.mark.parametrize("products, block", [(1 << 21, 5_000_000), (60, 30_000)])
def test_ehh_of_a_whole_table(spark, sf, monkeypatch, products, block):
    """Every site by a walk of its own; small blocks of products and of positions give the same."""
    monkeypatch.setattr(relations, "PRODUCTS", products)
    where = sites_of(spark, sf)
    gl = ad.gl(spark, sf)
    reach = 1_000_000 if block > 10**6 else 12_000
    got = {(r["chrom"], r["pos"]): r for r in relations.xp_ehh(gl, [0, 1, 2, 3], [6, 7, 8, 9], reach=reach, block=block, smallest=4).collect()}
    assert len(got) == sum(len(p) for p, _ in where.values())
    for c, (pos, g) in where.items():
        for k in range(len(pos)):
            for name, own in (("ihh_test", [0, 1, 2, 3]), ("ihh_ref", [6, 7, 8, 9])):
                assert got[c, int(pos[k])][name] == pytest.approx(relations.ehh_walk(pos, g[:, own], k, reach=reach), rel=1e-6)
    scores = {(r["chrom"], r["pos"]): r for r in relations.ihs(gl, reach=reach, block=block, smallest=2).collect()}
    n = 0
    for c, (pos, g) in where.items():
        for k in range(len(pos)):
            sure = g[k].max(1) >= 0.6
            anc, der = np.flatnonzero(sure & (g[k].argmax(1) == 0)), np.flatnonzero(sure & (g[k].argmax(1) == 2))
            p = float((g[k, :, 1] + 2 * g[k, :, 2]).mean() / 2)
            if min(p, 1 - p) >= 0.05 and len(anc) >= 2 and len(der) >= 2:
                n += 1
                x = scores[c, int(pos[k])]
                assert x["freq"] == pytest.approx(p, rel=1e-6)
                assert x["ihh_anc"] == pytest.approx(relations.ehh_walk(pos, g[:, anc], k, reach=reach), rel=1e-6)
                assert x["ihh_der"] == pytest.approx(relations.ehh_walk(pos, g[:, der], k, reach=reach), rel=1e-6)
    assert len(scores) == n > 0


def test_local_ancestry_of_a_whole_table(spark, sf):
    """Every window's proportions against the EM on its own sites; sites without frequencies, samples without a start."""
    from lociflow.operators import ancestry

    where, gl = sites_of(spark, sf), ad.gl(spark, sf)
    f = ad.f_matrix(gl).filter("pos % 3000 <> 1")
    q0 = ad.q_matrix(spark).filter("sample_idx <> 4")
    got = {(r["chrom"], r["window_id"], r["sample_idx"]): r for r in ancestry.local_q(gl, f, q0, 12, 6).collect()}
    known = {(r["chrom"], r["pos"]): r["f"] for r in f.collect()}
    start = {r["sample_idx"]: r["q"] for r in q0.collect()}
    q = np.array([start.get(i, [1 / 3] * 3) for i in range(ad.SAMPLES)])
    n = 0
    for c, (pos, _) in where.items():
        raw = np.array([[r["gl0"], r["gl1"], r["gl2"]] for r in gl.filter(F.col("chrom") == c).orderBy("pos", "sample_idx").collect()]).reshape(-1, ad.SAMPLES, 3)
        for w, i in enumerate(range(0, max(1, len(pos) - 11), 6)):
            own = slice(i, i + 12)
            want, _ = ancestry.em_proportions(raw[own], np.array([known.get((c, int(p)), [0.25] * 3) for p in pos[own]]), q)
            for s in range(ad.SAMPLES):
                r = got[c, w + 1, s]
                assert np.allclose(r["q"], want[s], atol=1e-9) and r["n_sites"] == len(pos[own]) and r["start"] == pos[own][0] and r["end"] == pos[own][-1]
                n += 1
    assert n == len(got) > 0


def test_local_ancestry_by_runs_of_windows(spark, sf):
    """Windows don't depend on the runs in which they are taken, and sites are not repeated for each window."""
    from lociflow.operators import ancestry

    gl = ad.gl(spark, sf)
    f, q0 = ad.f_matrix(gl), ad.q_matrix(spark)
    one, many = (sorted(tuple(map(str, r)) for r in ancestry.local_q(gl, f, q0, 12, 6, run=n).collect()) for n in (1, 7))
    assert one and one == many
