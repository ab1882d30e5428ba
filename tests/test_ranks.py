"""Rank tests of many regions against numpy, and drawn rank sums against full permutation."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import ranks, scan


def u_of(x, y):
    return sum(float((a > y).sum()) + float((a == y).sum()) / 2 for a in x)


def brute(rows, rest=None):
    of = defaultdict(list)
    for region, stat, v in rows:
        of[stat, region].append(v)
    out = {}
    for (stat, region), x in of.items():
        if region == rest:
            continue
        x = np.array(x)
        y = np.array([v for (s, r), vs in of.items() if s == stat and r != region and rest in (None, r) for v in vs])
        n, m = len(x), len(y)
        _, t = np.unique(np.concatenate([x, y]), return_counts=True)
        var = n * m / 12 * (n + m + 1 - (t.astype(float) ** 3 - t).sum() / max(1, (n + m) * (n + m - 1)))
        u = u_of(x, y) if n >= 2 and m >= 2 else None
        out[region, stat] = (n, m, x.mean(), y.mean() if m else None, np.median(x), np.median(y) if m else None, u, (u - n * m / 2) / np.sqrt(var) if u is not None and var > 0 else None)
    return out


COLUMNS = ("n_inside", "n_outside", "mean_inside", "mean_outside", "median_inside", "median_outside", "U", "z")


@pytest.mark.parametrize("rest", [None, "r0"])
def test_region_tests(spark, rest):
    """Ties, one region of half of all rows, regions of one row, a statistic with one region, all values equal."""
    r = np.random.default_rng(1)
    rows = [("r0" if r.random() < 0.5 else f"r{int(r.integers(1, 30))}", "a", float(r.integers(0, 40)) / 4) for _ in range(900)]
    rows += [("r1", "b", 1.0), ("r1", "b", 3.0), ("r0", "b", 2.0)] if rest else [("r1", "b", 1.0), ("r1", "b", 3.0)]
    rows += [("single", "a", 4.25), ("low", "a", -5.0), ("low", "a", -5.0), ("high", "a", 99.0)]
    rows += [(f"r{i % 3}", "same", 7.0) for i in range(12)]
    got = {(x["target"], x["stat_name"]): x for x in ranks.region_tests(spark.createDataFrame(rows, "region string, stat_name string, v double"), rest).collect()}
    want = brute(rows, rest)
    assert set(got) == set(want)
    for key, w in want.items():
        for c, x in zip(COLUMNS, w):
            assert got[key][c] == (x if x is None else pytest.approx(x, abs=1e-9)), (key, c)


def test_skipped_regions_take_no_part(spark):
    rows = [("a", float(i)) for i in range(5)] + [("b", float(i) + 1) for i in range(5)] + [("c", 100.0)] * 5
    df = spark.createDataFrame(rows, "region string, v double")
    got = {r["target"]: r["n_outside"] for r in scan.regions_against_rest(df, ["v"], skip=["c"]).collect()}
    assert got == {"a": 5, "b": 5}


@pytest.mark.parametrize("buckets", [200, 4])
def test_drawn_rank_sums(spark, monkeypatch, buckets):
    """Mean, spread and tails of the drawn distances against shuffled rows."""
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    r = np.random.default_rng(7)
    v = np.concatenate([np.repeat(3.0, 40), r.integers(0, 25, 160).astype(float)])
    rows = [("k", float(x), bool(i < 30)) for i, x in enumerate(r.permutation(v))]
    df = spark.createDataFrame(rows, "k string, v double, inside boolean")
    values = ranks.value_table(df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("t")), ["k"])
    devs = np.array(ranks.permuted(values, spark.createDataFrame([("k", 30)], "k string, n long"), ["k"], 4000).first()["devs"])
    x = np.array([a[1] for a in rows])
    rank = np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])
    plain = np.sort([abs(r.permutation(rank)[:30].sum() - 30 * 31 / 2 - 30 * 170 / 2) for _ in range(4000)])
    assert len(devs) == 4000 and list(devs) == sorted(devs)
    for q in (0.1, 0.5, 0.9, 0.97):
        assert np.quantile(devs, q) == pytest.approx(np.quantile(plain, q), rel=0.12)
    p = ranks.group_permutation_p(df, ["k"], 4000).first()["permutation_p"]
    seen = abs(rank[:30].sum() - 30 * 31 / 2 - 30 * 170 / 2)
    assert p == pytest.approx(((plain >= seen).sum() + 1) / 4001, abs=0.04)


def test_permutation_of_regions(spark):
    """A shifted region is found, an ordinary one is not; the same on every run; against a named rest as well."""
    r = np.random.default_rng(9)
    rows = [("far", float(x)) for x in r.normal(2, 1, 30)] + [("near", float(x)) for x in r.normal(0, 1, 30)] + [("rest", float(x)) for x in r.normal(0, 1, 200)] + [("one", 0.0)]
    df = spark.createDataFrame(rows, "region string, v double")
    for rest in (None, "rest"):
        runs = [{x["target"]: x["permutation_p"] for x in scan.regions_against_rest(df, ["v"], rest=rest, permutations=500).collect()} for _ in range(2)]
        assert runs[0] == runs[1]
        normal = {x["target"]: x["p"] for x in scan.regions_against_rest(df, ["v"], rest=rest).collect()}
        assert runs[0]["far"] == pytest.approx(1 / 501) and runs[0]["near"] == pytest.approx(normal["near"], abs=0.03) and runs[0]["one"] is None


def test_large_populations_are_drawn_from_the_normal():
    rng = np.random.default_rng(1)
    got = ranks._draw(rng, 3 * 10**9, np.full(2000, 10**9), np.full(2000, 1000))
    assert abs(got.mean() - 750) < 2 and abs(got.std() - np.sqrt(1000 * 0.75 * 0.25)) < 1
