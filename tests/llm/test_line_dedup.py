"""Line dedup: the query against SQL, and small tables against the contract in plain Python."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import line_dedup
from tests.llm.test_operators import DOCS, EDGES, frame
from tests.test_queries import rows, same

BLANK = " \t\n\x0b\x0c\r"


def brute(data):
    held = defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))
    rank = lambda i: (i is not None, i or 0)
    for i, t in data:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    keeper = {k: max(ids, key=rank) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3}
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.without_shared_lines(df).collect()), key=str)


@pytest.mark.parametrize("most", [200_000, 0])
def test_query_against_sql(spark, sf, duck, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    df = line_dedup.query(spark, sf)
    cur = duck.execute(line_dedup.SQL)
    names = [x[0] for x in cur.description]
    mine, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns) and len(mine) == len(want) > 100
    assert not [x for x in zip(mine, want) if not all(map(same, *x))]


@pytest.mark.parametrize("most", [200_000, 0])
def test_small_tables(spark, monkeypatch, most):
    """Blanks and case, lengths of 19 and 20, first and last lines, repeated lines, repeated rows and ids, null ids."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    r = np.random.default_rng(5)
    pool = ["a" * 20, "A" * 20, " \t" + "a" * 20 + "\x0b\r", "b" * 19, "Ä" * 20, "ä" * 20, "𝒳" * 20, "\xa0" + "c" * 20, "c" * 20 + " ", "", "d" * 30, "One line of more than twenty", "one LINE of more than twenty\r"]
    data = [(int(i) if i < 40 else None, "\n".join(r.choice(pool, r.integers(0, 9)))) for i in r.integers(0, 45, 60)]
    data += [data[0], data[0], (-5, "d" * 30), (99, "d" * 30 + "\n" + "d" * 30), (99, "x\n" + "d" * 30)]
    assert made(frame(spark, [(i, t, "s") for i, t in data])) == brute(data)
    few = [(None, "e" * 20), (1, "e" * 20), (2, "e" * 20 + "\n"), (None, "f" * 20), (None, "f" * 20), (None, "f" * 20 + "\nf"), (3, "g" * 20), (3, "g" * 20), (4, "g" * 20)]
    assert made(frame(spark, [(i, t, "s") for i, t in few])) == brute(few)


def test_edge_rows(spark):
    long = "\n".join(f"line {i % 50_000} of a very long text" for i in range(200_000))
    data = EDGES + [(20, long), (21, long), (22, long + "\nend"), (None, None)]
    df = frame(spark, [(i, t, "s") for i, t in data]).withColumns({c: F.lit(0) for c in ("text_hash", "pos", "h1", "h2", "keeper", "near", "places", "n")}).withColumn("a.b", F.lit(1))
    assert made(df) == brute(data)
    assert made(df.limit(0)) == []
