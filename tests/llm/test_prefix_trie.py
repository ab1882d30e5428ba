"""Conversation tries: the query against SQL, and small tables against tuples of turns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import prefix_trie
from tests.test_queries import rows, same

KIND = "conv_id long, turn long, role string, text string"


def brute(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    seqs = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + s[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def made(spark, data, kind=KIND):
    df = data if not isinstance(data, list) else spark.createDataFrame(data, kind)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(prefix_trie.encoded(df))))
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(params=[None, (100, 20, 0)], ids=["defaults", "dealt"])
def limits(request, monkeypatch):
    if request.param:
        for name, value in zip(("LOCAL_TURNS", "FEW", "BROADCAST_ROWS"), request.param, strict=True):
            monkeypatch.setattr(prefix_trie, name, value)


def test_query_against_sql(spark, sf, duck):
    df = prefix_trie.query(spark, sf)
    cur = duck.execute(prefix_trie.SQL)
    names = [x[0] for x in cur.description]
    mine, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns) and len(mine) == len(want) > 10
    assert not [x for x in zip(mine, want) if not all(map(same, *x))]


def test_small_tables(spark, limits):
    """Copies, prefixes of each other, absent families, negative ids, null roles, texts and turns, rows without an id, a turnless one."""
    r = np.random.default_rng(8)
    data = []
    for c in [*range(-12, 40), *range(5000, 5030), 10**12]:
        for turn in range(int(r.integers(1, 6))):
            data.append((c, None if turn == 0 and c % 3 == 0 else turn + 1, ["user", None, "assistant"][int(r.integers(0, 3)) if c % 2 else turn % 3], ["a", "é𝒳", "", None][int(r.integers(0, 4)) if c % 4 == 1 else turn % 4]))
    data += [(None, 1, "user", "a"), (None, None, None, None)]
    data += [(c, t, "user", f"copy {t}") for c in range(10_000, 10_060) for t in range(4)]
    want = brute(data)
    assert made(spark, data) == want
    assert any(len(x) == 8 and x[3] >= 40 and x[1] >= 3 for x in want)


def test_edge_rows(spark):
    data = [(1, t, "user", "x" * 1000) for t in range(40)] + [(2, 0, "a", "b")]
    df = spark.createDataFrame(data, KIND).withColumns({c: F.lit(0) for c in ("k1", "k2", "id", "bytes", "family", "bucket", "depth", "digit")}).withColumn("a.b", F.lit(1))
    assert made(spark, df) == brute(data)
    assert made(spark, df.limit(0)) == []
    repeated = [(5, 1, "u", "t")] * 4 + [(5, None, "u", "s")] * 2 + [(10, 2, "u", "p")] * 3
    assert made(spark, repeated) == brute(repeated)


def test_long_conversations(spark):
    """Two of 20,000 turns that part at the end; ids whose families are absent."""
    data = [(c, t, "user", f"{min(t, 19_998)}" if c == 6 or t < 19_999 else "other") for c in (6, 7) for t in range(20_000)]
    got = made(spark, data)
    one, two = (max(0, 20_000 - zlib.crc32(str(c).encode()) % 9) for c in (6, 7))
    assert len([x for x in got if x[4] == 0]) == 2 and got[0][5] == 2 and max(x[1] for x in got) == max(one, two)


def test_digest_of_many_blocks(spark):
    data = [(c * 1000 - 2000, 0, "u", "same") for c in range(600)]
    assert made(spark, data) == brute(data)
