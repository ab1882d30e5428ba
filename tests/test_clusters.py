"""Principal components against numpy, and average linkage against merging one pair after another."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from lociflow.operators import clusters, pca, relations
from lociflow.plans import adapters as ad
from lociflow.plans.ancestry import _dos


def brute(shared, samples):
    """Merges one nearest pair after another, with all distances written out. Returns merges and the order of leaves."""
    top = max(shared.values(), default=0)
    dist = lambda a, b: sum(top + 1 - shared.get((i, j), 0) for i in a for j in b) / (len(a) * len(b))
    now = {(s,): (-1.0, (s,)) for s in samples}
    merges = []
    while len(now) > 1:
        # sums of shares divided once, as equal means must compare equal
        key = lambda ab: (-sum(shared.get((i, j), 0) for i in ab[0] for j in ab[1]) / (len(ab[0]) * len(ab[1])), *sorted((min(ab[0]), min(ab[1]))))
        a, b = min(itertools.combinations(now, 2), key=key)
        a, b = sorted((a, b), key=min)
        h = dist(a, b)
        (ha, oa), (hb, ob) = now.pop(a), now.pop(b)
        merges.append((min(a), min(b), round(h, 9), len(a) + len(b)))
        now[tuple(sorted(a + b))] = (h, oa + ob if (ha, min(a)) < (hb, min(b)) else ob + oa)
    return sorted(merges), list(next(iter(now.values()))[1])


def check(spark, tables, samples):
    rows = [(b, i, j, v) for b, t in tables.items() for (i, j), v in t.items()]
    links = spark.createDataFrame(rows, "bin long, i int, j int, shared long")
    all_samples = spark.createDataFrame([(b, s) for b in tables for s in samples], "bin long, sample_idx int")
    merges, order = clusters.average_linkage(links, all_samples, ["bin"])
    got = defaultdict(list)
    for r in merges.collect():
        got[r["bin"]].append((r["lo"], r["hi"], round(r["height"], 9), r["size"]))
    leaves = defaultdict(list)
    for r in sorted(order.collect(), key=lambda r: r["place"]):
        leaves[r["bin"]].append(r["sample_idx"])
    for b, t in tables.items():
        want, places = brute(t, samples)
        assert sorted(got[b]) == want
        assert leaves[b] == places


def test_average_linkage(spark):
    """Many ties, samples that share nothing, one sample with all, one table of one link; all tables at once."""
    r = np.random.default_rng(2)
    tables = {}
    for b, (most, chance) in enumerate([(2, 0.9), (3, 0.5), (50, 1.0), (2, 0.1), (4, 0.3)]):
        t = {(s, s): int(r.integers(0, most + 1)) for s in range(0, 22, 2)}
        for i, j in itertools.combinations(range(0, 22, 2), 2):
            v = int(r.integers(1, most + 1)) * (r.random() < chance)
            if v:
                t[i, j] = t[j, i] = v
        tables[b] = t
    tables[9] = {(4, 6): 1, (6, 4): 1}
    check(spark, tables, list(range(0, 22, 2)))


def test_average_linkage_of_the_table(spark, sf):
    shared = defaultdict(dict)
    for r in relations.rare_sharing(_dos(spark, sf)).collect():
        shared[r["bin"]][r["i"], r["j"]] = r["shared"]
    check(spark, shared, list(range(ad.SAMPLES)))


def scores(x):
    """Scores of samples by singular values, the greatest absolute one positive."""
    x = np.where(np.isnan(x), np.nanmedian(x, axis=1)[:, None], x)
    _, s, v = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)
    out = (s[:, None] * v)[:2]
    return out * np.where(out.max(axis=1) >= -out.min(axis=1), 1, -1)[:, None]


@pytest.mark.parametrize("cells", [1 << 17, 30])
def test_local_components(spark, cells):
    """Windows of two steps with missing dosages and missing rows, as one panel and as several."""
    r = np.random.default_rng(4)
    n = 12
    base = r.normal(size=(2, n))
    x = np.round(np.clip(1 + r.normal(size=(60, 1)) * base[0] + 0.4 * r.normal(size=(60, 1)) * base[1] + 0.05 * r.normal(size=(60, n)), 0, 2), 3)
    x[r.random(x.shape) < 0.05] = np.nan
    rows = [("c", int(1000 * k + 5), int(3 * i), None if np.isnan(x[k, i]) else float(x[k, i])) for k in range(60) for i in range(n) if not (np.isnan(x[k, i]) and i % 2)]
    dos = spark.createDataFrame(rows, "chrom string, pos long, sample_idx int, dosage double")
    got = pca.local_pca(dos, 20_000, 10_000, 60 if cells > 100 else 25, cells).toPandas()
    assert sorted(got["start"].unique()) == [0, 10_000, 20_000, 30_000, 40_000, 50_000]
    for start, w in got.groupby("start"):
        own = x[start // 1000 : start // 1000 + 20]
        w = w.sort_values("sample_idx")
        assert w["n_sites"].iloc[0] == len(own) and list(w["sample_idx"]) == [3 * i for i in range(n)]
        want = scores(own)
        assert np.allclose(w["pc1"], want[0], atol=1e-3 if cells > 100 else 0.02) and np.allclose(w["pc2"], want[1], atol=1e-3 if cells > 100 else 0.05)


def test_first_component(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 1)) * r.normal(size=8) + 0.1 * r.normal(size=(200, 8))
    dos = spark.createDataFrame([("c" if k % 2 else "d", k, i, float(x[k, i])) for k in range(200) for i in range(8)], "chrom string, pos long, sample_idx int, dosage double")
    got = pca.first_component(dos).orderBy("sample_idx").toPandas()
    v = np.linalg.svd(x - x.mean(axis=1, keepdims=True))[2][0]
    assert np.allclose(np.abs(got["pc1"]), np.abs(v), atol=1e-6)
    assert list(np.argsort(got["pc1"])) == list(np.argsort(got["place"]))


def test_class_order(spark):
    rows = spark.createDataFrame([(1, "b", 0.5), (2, "a", 0.9), (3, "a", 0.1), (3, "a", 0.3), (4, "b", 0.5)], "sample long, cls string, v double")
    got = clusters.class_order(rows, "sample", "cls", "v").orderBy("place").collect()
    assert [(r["sample"], r["cls"]) for r in got] == [(3, "a"), (2, "a"), (1, "b"), (4, "b")]
