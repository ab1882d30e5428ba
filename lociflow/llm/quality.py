"""Quality by ordinal regression: a cumulative-link model with one weight for each hashed text feature.

Grades are ordered (0 toxic, 1 poor, 2 good). All grades share the weights w; ordered thresholds t1 < t2 cut the
score: P(grade >= j) = 1 / (1 + exp(t_j - w.x)). The model gives the expected grade and the tail probability of the
best grade, on which documents are selected.

Features are hashes, to one of 2^BITS weights, of words, of the first bytes of words, and of steps of shape shares (words in
capitals, words that end in a symbol, words that repeat their neighbour, digits, length). A feature counts once in a document. All
of them have a weight; weights and thresholds maximize the likelihood less an L1 penalty (dual averaging with AdaGrad's steps),
which leaves at zero what the labels don't support.

The model is fitted on a bounded sample: the labels of about `max_rows` documents, and of fewer if these hold more than `max_places`
places of weights, taken by a hash of doc_id, with the counts of each grade as weights; every document is scored over its whole text.

Defined results: null and empty texts have only length features and are scored like any other; equal texts get
equal scores; rows of one document in `labels` count as several observations; of documents that share a labelled doc_id one is
fitted, the one of the least text hash, and all are scored; labels without a document or with a null are left out; without
labels of two grades every document gets the middle of the scale and is kept; an empty table gives an empty result; rows without a
doc_id and repeated rows are scored like others; other columns are ignored by `score` and kept by `stage`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import bytescan as bs
from lociflow.llm.storage import cut, drop

MAX_ROWS, BITS = 10_000, 18
#: Places of weights that the fitting rows bring to the driver at most (64 MB), and in how many parts rows are taken.
MAX_PLACES, BUCKETS = 1 << 24, 1024
#: Least probability of the best grade with which a document is kept.
LEAST_TAIL = 0.4
PREFIXES = (4, 5, 6, 7, 8, 10)
SHARES = (0.01, 0.03, 0.1, 0.3, 0.6)
LENGTHS = (1, 3, 10, 30)
GRADES = 3
U = np.uint64

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "*#$%&!|<>"]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


def _kind(i: int) -> np.uint64:
    return bs.randoms(64, 7)[i]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs of a slice, features of words with repeats."""
    n = len(offsets) - 1
    h, starts, ends, first = bs.word_hashes(raw, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    docs, feats = [doc], [h]
    if len(h):
        size = ends - starts
        low = bs._byte
        for p in PREFIXES:
            long = np.flatnonzero(size > p)
            acc = np.zeros(len(long), U)
            at = starts[long]
            with np.errstate(over="ignore"):
                for j in range(p):
                    acc += low[raw[at + j]] * bs._place[j]
            docs.append(doc[long])
            feats.append(bs.mix(acc ^ _kind(p)))
    total = np.maximum(count, 1)
    share = lambda flag: np.bincount(doc[flag], minlength=n) / total
    if len(h):
        cum = lambda t: np.concatenate([[0], np.cumsum(t[raw])])
        up, lo, dg = cum(_upper), cum(_lower), cum(_digit)
        ups, los, dgs = up[ends] - up[starts], lo[ends] - lo[starts], dg[ends] - dg[starts]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        same2 = np.concatenate([[False] * 2, (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])])[: len(h)]
        shares = [share((ups >= 2) & (los == 0)), share(_symbol[raw[ends - 1]]), share(same), share(same | same2), share(dgs > 0)]
    else:
        shares = [np.zeros(n)] * 5
    for i, s in enumerate(shares):
        for j, at in enumerate(SHARES):
            d = np.flatnonzero(s > at)
            docs.append(d)
            feats.append(np.full(len(d), _kind(16 + i) + U(j)))
    for j, at in enumerate(LENGTHS):
        d = np.flatnonzero(count < at)
        docs.append(d)
        feats.append(np.full(len(d), _kind(31) + U(j)))
    return np.concatenate(docs), np.concatenate(feats)


def places(raw: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place of a weight) without repeats, in order; only places that are used, if given."""
    doc, f = features(raw, offsets)
    at = (f >> U(64 - BITS)).astype(np.int64)
    if used is not None:
        some = np.flatnonzero(used[at])
        doc, at = doc[some], at[some]
    pairs = np.sort((doc << BITS) | at)
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    pairs = pairs[new]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """2^BITS weights; thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        out, used = np.zeros(len(column)), self.weights != 0
        for i, raw, offsets in bs.text_slices(column):
            doc, at = places(raw, offsets, used)
            out[i : i + len(offsets) - 1] = np.bincount(doc, self.weights[at], minlength=len(offsets) - 1)
        return out


def fit_weights(at: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, grades: int = GRADES, steps: int = 600, epochs: int = 8, batch: int = 256, rate: float = 0.15, l1: float = 0.03, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from sparse rows of ones: row i has the features at[offsets[i]:offsets[i + 1]], the grade y[i] and counts
    weight[i] times. There are `steps` steps at least and `epochs` passes at least; the penalty is l1 over the root of the number of rows.
    Thresholds stay in order: they are the first one and positive gaps."""
    n, r = len(y), np.random.default_rng(seed)
    l1, epochs = l1 / np.sqrt(n), max(epochs, -(-steps * batch // n))
    weight = weight / weight.mean()
    below = np.array([np.clip((weight * (y <= j)).sum() / weight.sum(), 0.01, 0.99) for j in range(grades - 1)])
    t = np.log(below / (1 - below))
    q = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 0.05))])
    u, squares, w = np.zeros(size), np.full(size, 1e-8), np.zeros(size)
    q_squares, step = np.full(len(q), 1e-2), 0
    for _ in range(epochs):
        order = r.permutation(n)
        for k in range(0, n, batch):
            own = order[k : k + batch]
            step += 1
            count = offsets[own + 1] - offsets[own]
            row = np.repeat(np.arange(len(own)), count)
            feats = at[np.repeat(offsets[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            s = np.bincount(row, w[feats], minlength=len(own))
            gaps = np.exp(q[1:])
            t = q[0] + np.concatenate([[0], np.cumsum(gaps)])
            cdf = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -30, 30)))
            edge = np.concatenate([np.zeros((len(own), 1)), cdf, np.ones((len(own), 1))], 1)
            slope = np.concatenate([np.zeros((len(own), 1)), cdf * (1 - cdf), np.zeros((len(own), 1))], 1)
            i, z, v = np.arange(len(own)), y[own], weight[own] / len(own)
            like = np.maximum(edge[i, z + 1] - edge[i, z], 1e-9)
            hi, lo = v * slope[i, z + 1] / like, v * slope[i, z] / like
            by_t = np.array([lo[z == j + 1].sum() - hi[z == j].sum() for j in range(grades - 1)])
            g = np.bincount(feats, (hi - lo)[row], minlength=size)  # of the loss: scores go down as thresholds go up
            u += g
            squares += g * g
            w = -np.sign(u) * np.maximum(np.abs(u) - l1 * step, 0) * rate / np.sqrt(squares)
            gq = np.concatenate([[by_t.sum()], np.array([by_t[j + 1 :].sum() for j in range(grades - 2)]) * gaps])
            q_squares += gq * gq
            q -= rate * gq / np.sqrt(q_squares)
    return w, q[0] + np.concatenate([[0], np.cumsum(np.exp(q[1:]))])


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text and how often each grade is given (n0, n1, ...), of about max_rows labelled documents at most, taken by a hash of
    doc_id. The labels are broadcast to the documents, so that no text moves."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).select("doc_id", grade.alias("grade"))
    rows = known.groupBy("doc_id").agg(*[F.count(F.when(F.col("grade") == j, 1)).alias(f"n{j}") for j in range(GRADES)])
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def fitting_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES) -> pa.Table:
    """h, t, n0, n1, ..., at (places of weights) of the fitting rows. They are coded on the executors into a table; the driver gets those
    in the first BUCKETS-ths of the range of hashes that hold max_places places in all, so its memory is bounded whatever the texts' lengths."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, offsets in bs.text_slices(batch.column("text")):
                k = len(offsets) - 1
                doc, at = places(raw, offsets)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=k))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
                yield pa.record_batch([*[batch.column(c).slice(i, k) for c in ("h", "t", *counts)], lists], ["h", "t", *counts, "at"])

    counts = [f"n{j}" for j in range(GRADES)]
    rows = labelled(docs, labels, max_rows).withColumns({"h": F.xxhash64("doc_id"), "t": F.xxhash64(F.coalesce("text", F.lit("")))})
    coded = rows.select("h", "t", "text", *counts).mapInArrow(encode, "h long, t long, " + ", ".join(f"{c} long" for c in counts) + ", at array<int>")
    table, path = cut(coded.groupBy("h").agg(F.min(F.struct("t", *counts, "at")).alias("x")).select("h", "x.*"), "coded")
    bucket = F.pmod("h", F.lit(BUCKETS))
    sizes = sorted(table.groupBy(bucket.alias("b")).agg(F.sum(F.size("at")).alias("n")).collect())  # at most BUCKETS rows
    total, most = 0, BUCKETS
    for b, n in sizes:
        total += n
        if total > max_places:
            most = b
            break
    got = table.filter(bucket < most).toArrow().combine_chunks()
    drop(docs.sparkSession, path)
    return got


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES) -> Model:
    """The model of the fitting rows: about max_rows documents at most, and max_places places of weights (four bytes each) at most."""
    got = fitting_rows(docs, labels, max_rows, max_places)
    counts = [f"n{j}" for j in range(GRADES)]
    none = Model(np.zeros(1 << BITS), np.full(GRADES - 1, -30.0))
    number = np.stack([got[c].to_numpy() for c in counts]) if len(got) else np.zeros((GRADES, 0))
    if (number.sum(1) > 0).sum() < 2:
        return none
    lists = got["at"].combine_chunks()
    ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    order = np.argsort(got["h"].to_numpy(), kind="stable")  # the same sums whatever the order of tasks
    grade, place = np.nonzero(number[:, order])
    place = order[place]
    size = ends[place + 1] - ends[place]
    first = np.concatenate([[0], np.cumsum(size)])
    at = flat[np.repeat(ends[place] - first[:-1], size) + np.arange(first[-1])] if len(np.unique(place)) < len(place) or not np.array_equal(place, np.arange(len(place))) else flat
    return Model(*fit_weights(at, first, grade, number[grade, place].astype(float), 1 << BITS))


def score(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, expected_grade, tail (probability of the best grade), kept (tail >= least_tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column("text"))
            above = [1 / (1 + np.exp(np.clip(t - s, -60, 60))) for t in model.thresholds]
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array(sum(above)), pa.array(above[-1]), pa.array(above[-1] >= least_tail)], ["doc_id", "score", "expected_grade", "tail", "kept"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, tail double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumns({c: F.round(c, 6) for c in ("score", "expected_grade", "tail")})


def select_rows(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs that are kept, whole; texts pass through the scorer once and nothing is joined."""

    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns may have any names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(at))
            yield batch.filter(pa.array(1 / (1 + np.exp(np.clip(model.thresholds[-1] - s, -60, 60))) >= least_tail))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model keeps, as they are: rows without text or doc_id and repeated rows are scored like others."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return select_rows(docs, model)
