"""Spelling variants: the query against SQL, and small vocabularies against edits written out."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import variants
from tests.llm.test_operators import DOCS, EDGES, frame
from tests.test_queries import rows, same


def brute(counts):
    """The contract on word counts, with all neighbours made as strings."""
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    letters = sorted(set("".join(words)))
    out = {}
    for w, n in words.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = (near - {w}) & set(words)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, n, len(near)]
    for w in out:
        top = w
        while out[top][0]:
            top = out[top][0]
        out[w].append(top)
    return {w: (f, root, n, k, words.get(f)) for w, (f, n, k, root) in out.items()}


def words_of(rows_):
    found = Counter()
    for i, t in rows_:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in t or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return found


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_against_sql(spark, sf, duck):
    df = variants.query(spark, sf)
    cur = duck.execute(variants.SQL)
    names = [x[0] for x in cur.description]
    mine, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns) and len(mine) == len(want) > 1000
    assert not [x for x in zip(mine, want) if not all(map(same, *x))]


@pytest.mark.parametrize("limit", [1 << 23, 7])
def test_small_vocabularies(spark, monkeypatch, limit):
    """Ways of several steps, equal letters, ties, letters beyond A-Z, long words; one bitmap and several."""
    monkeypatch.setattr(variants, "PASS_WORDS", limit)
    r = np.random.default_rng(3)
    some = ["aaaaa", "aaaaaa", "aaaab", "aabaa", "baaaa", "äaaaa", "ÿaaaa", "aaaa÷", "abcdef", "abcdeg", "abcdeff", "bcdef", "x" * 200, "x" * 199 + "y", "x" * 201]
    some += ["".join(r.choice(list("abé"), r.integers(5, 8))) for _ in range(60)]
    text = lambda: " ".join(str(w) for w in r.permutation([w for w in some for _ in range(int(2 ** r.integers(0, 4)))]))
    data = [(i, text()) for i in range(6)] + [(None, "Aaaaa AAAAB"), (7, None), (7, ""), (8, "mnopq " * 48 + "mnopr " * 24 + "mnosr " * 12 + "mntsr " * 6 + "mutsr " * 3)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
    want = brute(words_of(data))
    assert got(variants.variants(df)) == want
    assert max(len(w) for w in want) >= 199 and any(v[0] and want[v[0]][0] for v in want.values())


def test_roots_of_long_ways(spark):
    links = spark.range(1, 200).select("id", (F.col("id") - 1).alias("form"))
    assert {r["root"] for r in variants.roots(links).collect()} == {0}
    assert variants.roots(links.limit(0)).count() == 0


def test_edge_rows(spark):
    rows_ = EDGES + [(None, "word " * 5), (2, "l" * 30_000 + " " + "l" * 30_000 + " " + "l" * 30_000)]
    df = frame(spark, [(i, t, "s") for i, t in rows_]).withColumns({c: F.lit(0) for c in ("word", "n", "id", "key", "best", "form")})
    assert got(variants.variants(df)) == brute({w: n for w, n in words_of(rows_).items() if len(w) < 100}) | {w: (None, w, n, 0, None) for w, n in words_of(rows_).items() if len(w) >= 100 and n >= 3}
    assert variants.variants(df.limit(0)).count() == 0
