"""Every query of the library runs; those with SQL give the same rows as DuckDB."""

import pytest

from lociflow import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in found]
    return sorted(out, key=lambda r: tuple((x is None, str(round(x, 3)) if isinstance(x, float) else str(x)) for x in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or a == b or abs(a - float(b)) <= 2e-5 * max(1, abs(a)))
    return a == b or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    assert not [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_segments_of_all_sites(spark, sf):
    """Every site of a chromosome is counted for each of its candidates."""
    from lociflow.plans import adapters

    got = {r["candidate_id"]: r["n"] for r in QUERIES["anc_segments"](spark, sf).groupBy("candidate_id").agg({"n_sites": "sum"}).withColumnRenamed("sum(n_sites)", "n").collect()}
    sites = {r["chrom"]: r["count"] for r in adapters.gl(spark, sf).select("chrom", "pos").distinct().groupBy("chrom").count().collect()}
    assert got == {f"c{c}_{k}": sites[f"chr{c}"] for c in range(1, 8) for k in range(3)} | {"far": sites["chr1"]}
