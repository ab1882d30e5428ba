"""Quality rules with line sequence labelling.

Every document gets counts (words, symbols, repeated lines and words). Its lines are then labelled content or
boilerplate by a linear-chain conditional random field: each line has binary features, the chain has weights for
neighbouring labels, and Viterbi decoding picks the best labelling of all lines together. A document is kept if the
counts pass and the words of its content lines make up at least `least_share` of all.

The field is trained on documents composed by rule (`composed`), with forward-backward gradients in numpy.

Defined results: null and empty texts have zero counts, fail and are not kept; equal rows get equal results; lines
without a word take part in no count and no labelling; a text of any length is decoded whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import models

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
LEAST_SHARE = 0.5
#: Fixed cue words of notices, menus and licences.
CUES = re.compile(rb"(?i)licen[sc]e|copyright|all rights|cookie|subscribe|click here|privacy|terms of|sign up|log ?in|newsletter|read more|share this|https?://|www\.|\(c\)|powered by")
FEATURES = 24
_ends = re.compile(rb"[#*$%&|<>](?=\s|$)")
_not_upper = bytes(b for b in range(256) if not 65 <= b <= 90)
_not_digit = bytes(b for b in range(256) if not 48 <= b <= 57)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    _, pair = np.unique(x[:-1] * m + x[1:], return_inverse=True)
    _, inv, count = np.unique(pair[:-1].astype(np.int64) * m + x[2:], return_inverse=True, return_counts=True)
    again = count[inv] > 1
    hit = np.zeros(n, bool)
    for j in range(3):
        hit[j : n - 2 + j] |= again
    return int(hit.sum())


def _features(line: bytes, words: list[bytes], seen: bool, first: bool, last: bool) -> tuple[int, ...]:
    """Numbers of the features that hold."""
    n, size = len(words), max(1, len(line))
    sym = len(_ends.findall(line)) / n
    caps = 2 * len(line.translate(None, _not_upper)) / size
    same = sum(map(eq, words, words[1:])) / n
    digits = 2 * len(line.translate(None, _not_digit)) / size
    mean = (size - n) / n
    out = [0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3 if n < 40 else 4]
    out.append(5 if sym > 0.4 else 6 if sym > 0.15 else 7 if sym > 0 else 8)
    out.append(9 if caps > 0.5 else 10 if caps > 0.2 else 11)
    out.append(12 if same > 0.4 else 13 if same > 0.1 else 14)
    if digits > 0.3:
        out.append(15)
    if seen:
        out.append(16)
    if CUES.search(line):
        out.append(17)
    out.append(18 if line.rstrip()[-1:] in b".!?" else 19)
    if first:
        out.append(20)
    if last:
        out.append(21)
    if mean > 14:
        out.append(22)
    if line.count(b"!!") * 3 > n:
        out.append(23)
    return tuple(out)


def lines_of(raw: bytes) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and words of each line with a word, and how many of these lines equal an earlier one."""
    feats, sizes, seen, dup = [], [], set(), 0
    lines = [(x, w) for x in raw.split(b"\n") if (w := x.split())]
    for i, (x, w) in enumerate(lines):
        old = x in seen
        dup += old
        seen.add(x)
        feats.append(_features(x, w, old, i == 0, i == len(lines) - 1))
        sizes.append(len(w))
    return feats, sizes, dup


def viterbi(weights: np.ndarray, feats: list[tuple[int, ...]]) -> list[int]:
    """The best labels (0 content, 1 boilerplate). weights: FEATURES for each label, then the 2 x 2 chain."""
    w = [weights[: FEATURES].tolist(), weights[FEATURES : 2 * FEATURES].tolist()]
    (t00, t01), (t10, t11) = weights[2 * FEATURES :].reshape(2, 2).tolist()
    back, a, b = [], 0.0, 0.0
    for i, f in enumerate(feats):
        e0, e1 = sum(w[0][k] for k in f), sum(w[1][k] for k in f)
        if i:
            p, q = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10), (0, a + t01) if a + t01 > b + t11 else (1, b + t11)
            back.append((p[0], q[0]))
            a, b = p[1] + e0, q[1] + e1
        else:
            a, b = e0, e1
    out = [0 if a >= b else 1]
    for p in reversed(back):
        out.append(p[out[-1]])
    return out[::-1] if feats else []


def gradient(weights: np.ndarray, feats: list[tuple[int, ...]], labels: list[int]) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels and its gradient, by forward-backward in log space."""
    n = len(feats)
    u = np.stack([weights[:FEATURES], weights[FEATURES : 2 * FEATURES]])
    t = weights[2 * FEATURES :].reshape(2, 2)
    e = np.array([u[:, list(f)].sum(1) for f in feats])
    fw, bw = np.empty((n, 2)), np.zeros((n, 2))
    fw[0] = e[0]
    for i in range(1, n):
        fw[i] = e[i] + np.logaddexp.reduce(fw[i - 1][:, None] + t, 0)
    for i in range(n - 2, -1, -1):
        bw[i] = np.logaddexp.reduce(t + (e[i + 1] + bw[i + 1])[None, :], 1)
    z = np.logaddexp.reduce(fw[-1])
    p = np.exp(fw + bw - z)
    g, gu, gt, like = np.zeros_like(weights), np.zeros((2, FEATURES)), np.zeros((2, 2)), -z
    for i, f in enumerate(feats):
        ix = list(f)
        gu[labels[i], ix] += 1
        gu[0, ix] -= p[i, 0]
        gu[1, ix] -= p[i, 1]
        like += e[i, labels[i]]
        if i:
            gt[labels[i - 1], labels[i]] += 1
            gt -= np.exp(fw[i - 1][:, None] + t + (e[i] + bw[i])[None, :] - z)
            like += t[labels[i - 1], labels[i]]
    g[:FEATURES], g[FEATURES : 2 * FEATURES], g[2 * FEATURES :] = gu[0], gu[1], gt.ravel()
    return like, g


def train(docs: list[tuple[list[tuple[int, ...]], list[int]]], epochs: int = 8, rate: float = 0.2, ridge: float = 1e-3, seed: int = 6) -> np.ndarray:
    """Weights by AdaGrad over documents of line features with labels."""
    w, acc, r = np.zeros(2 * FEATURES + 4), np.full(2 * FEATURES + 4, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(docs)):
            _, g = gradient(w, *docs[i])
            g -= ridge * w
            acc += g * g
            w += rate * g / np.sqrt(acc)
    return w


def composed(n: int, seed: int) -> list[tuple[bytes, list[int]]]:
    """Documents made by rule, with a label for each line: prose of invented words, and blocks of menus, licences,
    shouting, decorated words, repeated words and repeated lines."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    word = lambda: "".join(pick(["an", "er", "on", "th", "e", "in", "o", "re", "la", "sch", "qu", "é"]) for _ in range(int(r.integers(1, 5))))
    many = lambda a, b: [word() for _ in range(int(r.integers(a, b)))]

    def prose() -> str:
        out = []
        for _ in range(int(r.integers(1, 6))):
            w = many(1, 25)
            out.append(" ".join([w[0].capitalize(), *[x + ("," if r.random() < 0.1 else "") for x in w[1:]]]) + ".")
        if r.random() < 0.08:
            out.insert(int(r.integers(len(out) + 1)), pick(["+1 (555) 010-2000", "192.0.2.7", "a.b@example.org", "4111 1111", "2,000", "A & B", "token = \"0a1b2c\""]))
        return " ".join(out)

    def junk() -> str:
        k = int(r.integers(7))
        w = prose().split() if k in (0, 2, 3) and r.random() < 0.7 else many(2, 40)
        if k == 0:
            return pick([" | ", " > ", " * "]).join(w)
        if k == 1:
            return pick(["Licensed under the {} License, Version 2.0.", "Copyright 2020 {}. All rights reserved.", "We use cookies to improve {}.", "Subscribe to our {} newsletter", "Click here to read more {}", "This file is part of {} and is distributed under the terms of the {} License."]).replace("{}", word())
        if k == 2:
            return " ".join(x.upper() + "!!" for x in w)
        if k == 3:
            return " ".join(x + pick(["***", "###", "$$$", "%%%", "&&&"]) for x in w)
        if k == 4:
            return " ".join(x for x in w[:6] for _ in range(int(r.integers(4, 15))))
        if k == 5:
            return " ".join(many(1, 4))
        return " ".join(str(x) for x in r.integers(0, 5000, len(w)))

    out = []
    for _ in range(n):
        lines, labels, bad = [], [], r.random() < 0.35
        for _ in range(int(r.integers(1, 14))):
            if r.random() < 0.08:
                bad = not bad
            lines.append(junk() if bad else prose())
            labels.append(int(bad))
        out.append(("\n".join(lines).encode(), labels))
    return out


def trained(n: int = 700, seed: int = 6) -> np.ndarray:
    return train([(lines_of(raw)[0], labels) for raw, labels in composed(n, seed)], seed=seed)


@lru_cache(maxsize=1)
def default_weights() -> tuple[float, ...]:
    """The stored weights of trained()."""
    return tuple(models.load("line_quality")["weights"])


def rules(docs: DataFrame, least_share: float = LEAST_SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words, content_share, base_failed, kept."""
    weights = np.array(default_weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                t = t.as_py() or ""
                raw = t.encode("utf-8", "surrogatepass")
                words = raw.split()
                n = len(words)
                feats, sizes, dup = lines_of(raw)
                again = repeated_words(words)
                content = sum(s for s, y in zip(sizes, viterbi(weights, feats), strict=True) if y == 0)
                failed = n < MIN_WORDS or 100 * again > MOST_REPEATED * n
                rows.append((n, len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r"), sum(t.count(c) for c in SYMBOLS), dup, again, content, content / n if n else 0.0, failed, not failed and content >= least_share * n))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.float64()), *[pa.array(c, pa.bool_()) for c in cols[7:]]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "content_share", "base_failed", "kept"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, content_share double, base_failed boolean, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
