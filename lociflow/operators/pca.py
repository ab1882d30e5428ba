"""Principal components of samples, over all sites or by window, from Gram matrices that are summed where sites lie.

A task turns each Arrow batch of sites into a matrix and adds its products to panels of a Gram matrix (blocks of rows of bounded size);
panels are summed in two levels, so that no task meets all parts of one. Windows are sums of the Gram matrices of their steps. Where a
matrix is one panel, the task that holds it iterates alone; larger ones are multiplied as a distributed product, round by round, and
only vectors move. No row stands for a pair of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.sources import scratch

#: Numbers of a panel: 1 MB.
PANEL = 1 << 17
#: Bytes of panels that a task gathers before it lets them go, and first-level groups of a sum.
HELD, SPREAD = 64 << 20, 16


def site_vectors(dos: DataFrame, step: int | None = None) -> DataFrame:
    """chrom, cell (number of the step, 0 without), s (samples), d (dosages): a row for each site."""
    cell = F.lit(0).cast("long") if step is None else F.floor(F.col("pos") / step).cast("long")
    chrom = F.lit("") if step is None else F.col("chrom")
    site = dos.groupBy("chrom", "pos").agg(F.collect_list(F.struct("sample_idx", "dosage")).alias("v"))
    return site.select(chrom.alias("chrom"), cell.alias("cell"), F.col("v.sample_idx").alias("s"), F.col("v.dosage").alias("d"))


def centred(batch: pa.RecordBatch, samples: np.ndarray) -> np.ndarray:
    """sites x samples; a missing dosage is the site's median, and every site has mean 0. Sites without any dosage are 0."""
    s, d = batch.column("s"), batch.column("d")
    ends = s.offsets.to_numpy()
    x = np.full((batch.num_rows, len(samples)), np.nan)
    at = np.searchsorted(samples, s.values.to_numpy()[ends[0] : ends[-1]])
    ends_d = d.offsets.to_numpy()
    x[np.repeat(np.arange(batch.num_rows), np.diff(ends)), at] = d.values.to_numpy(zero_copy_only=False)[ends_d[0] : ends_d[-1]]
    some = ~np.isnan(x).all(axis=1)
    x[~some] = 0.0
    holes = np.isnan(x)
    if holes.any():
        x = np.where(holes, np.nanmedian(x, axis=1)[:, None], x)
    return x - x.mean(axis=1, keepdims=True)


def _panels(n: int, cells: int) -> list[tuple[int, int]]:
    """First and last row of each panel of an n x n matrix."""
    rows = max(1, min(n, cells // n))
    return [(i, min(n, i + rows)) for i in range(0, n, rows)]


def _rows(acc: dict) -> pa.RecordBatch:
    keys = list(acc)
    return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array([acc[k][0].tobytes() for k in keys], pa.binary()), pa.array([acc[k][1] for k in keys], pa.int64())], ["chrom", "cell", "panel", "g", "n_sites"])


PARTS = "chrom string, cell long, panel int, g binary, n_sites long"


def _products(batches: Iterator[pa.RecordBatch], samples: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    acc: dict[tuple, tuple[np.ndarray, int]] = {}
    held, panels = 0, _panels(len(samples), cells)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = centred(batch, samples)
        where: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column("chrom").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
            where.setdefault(key, []).append(i)
        for key, rows in where.items():
            own = x[rows]
            for p, (a, b) in enumerate(panels):
                g, n = acc.get((*key, p), (0.0, 0))
                held += 0 if n else 8 * (b - a) * len(samples)
                acc[(*key, p)] = (g + own[:, a:b].T @ own, n + len(rows))
                if held > HELD:
                    yield _rows(acc)
                    acc, held = {}, 0
    if acc:
        yield _rows(acc)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the panels of a group."""
    key, g, n = None, 0.0, 0
    for batch in batches:
        for c, w, p, part, m in zip(*[batch.column(x).to_pylist() for x in ("chrom", "cell", "panel", "g", "n_sites")], strict=True):
            key, g, n = (c, w, p), g + np.frombuffer(part), n + m
    if key:
        yield _rows({key: (g, n)})


def grams(sites: DataFrame, samples: np.ndarray, steps: int = 1, cells: int = PANEL) -> DataFrame:
    """chrom, cell, panel, g (rows of the Gram matrix), n_sites. With steps > 1 a cell stands for that many neighbours from it on."""
    parts = sites.mapInArrow(lambda b: _products(b, samples, cells), PARTS)
    salted = parts.withColumn("salt", F.spark_partition_id() % SPREAD)
    first = salted.groupBy("chrom", "cell", "panel", "salt").applyInArrow(_summed, PARTS)
    if steps > 1:
        first = first.withColumn("cell", F.explode(F.sequence(F.greatest(F.lit(0), F.col("cell") - (steps - 1)), F.col("cell"))))
    return first.groupBy("chrom", "cell", "panel").applyInArrow(_summed, PARTS)


def power(g: np.ndarray, k: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """k vectors of unit length (columns) and their values: power iteration from 1, 2, ..., each after the first freed of those before."""
    n = len(g)
    out, values = np.zeros((n, k)), np.zeros(k)
    for j in range(k):
        v = np.arange(1.0, n + 1)
        for _ in range(iterations):
            w = g @ v
            for i in range(j):
                w -= (out[:, i] @ w) * out[:, i]
            size = np.sqrt(w @ w)
            v = w / size if size else w
        out[:, j], values[j] = v, v @ g @ v
    return out, values


VECTORS = "chrom string, cell long, n_sites long, component int, value double, v array<double>"


def _vectors(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["chrom", "cell", "n_sites", "component", "value", "v"])


def _alone(batches: Iterator[pa.RecordBatch], n: int, k: int, iterations: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for c, w, g, m in zip(*[batch.column(x).to_pylist() for x in ("chrom", "cell", "g", "n_sites")], strict=True):
            vs, values = power(np.frombuffer(g).reshape(n, n), k, iterations)
            out += [(c, w, m, j + 1, float(values[j]), vs[:, j]) for j in range(k)]
        if out:
            yield _vectors(out)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chrom, cell, panel, n_sites, w: the part of the product that a panel gives."""
    for batch in batches:
        out = []
        for c, w, p, m, g, v in zip(*[batch.column(x).to_pylist() for x in ("chrom", "cell", "panel", "n_sites", "g", "v")], strict=True):
            out.append((c, w, p, m, np.frombuffer(g).reshape(-1, len(v)) @ np.array(v)))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["chrom", "cell", "panel", "n_sites", "w"])


def _freed(batches: Iterator[pa.RecordBatch], component: int) -> Iterator[pa.RecordBatch]:
    """The next vector from a product w, freed of the components before; value is the product with the vector v that made it."""
    for batch in batches:
        out = []
        for c, cell, m, w, v, before in zip(*[batch.column(x).to_pylist() for x in ("chrom", "cell", "n_sites", "w", "v", "before")], strict=True):
            w = np.array(w)
            value = float(np.array(v) @ w)
            for u in before or []:
                u = np.array(u)
                w = w - (u @ w) * u
            size = np.sqrt(w @ w)
            out.append((c, cell, m, component, value, w / size if size else w))
        if out:
            yield _vectors(out)


def _rounds(panels: DataFrame, n: int, k: int, iterations: int) -> DataFrame:
    """As _alone, with matrices of several panels: each round is a join of panels and vectors, and a sum of parts."""
    spark = panels.sparkSession

    def cut(df: DataFrame, name: str) -> DataFrame:
        path = scratch.folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    keys = ["chrom", "cell"]
    panels = cut(panels, "panels")
    found = None
    for j in range(1, k + 1):
        now = panels.groupBy(*keys).agg(F.first("n_sites").alias("n_sites")).select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double")).alias("v"))
        before = None if found is None else found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("component", "v"))), lambda x: x["v"]).alias("before"))
        for turn in range(iterations + 1):  # the last product gives the value alone
            parts = panels.join(now.select(*keys, "v"), keys).mapInArrow(_multiplied, "chrom string, cell long, panel int, n_sites long, w array<double>")
            whole = parts.groupBy(*keys).agg(F.first("n_sites").alias("n_sites"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("panel", "w"))), lambda x: x["w"])).alias("w")).join(now.select(*keys, "v"), keys)
            whole = whole.join(before, keys) if before is not None else whole.withColumn("before", F.lit(None).cast("array<array<double>>"))
            then = whole.mapInArrow(lambda b, j=j: _freed(b, j), VECTORS)
            if turn < iterations:
                now = cut(then, "vectors")
            else:
                own = cut(now.drop("value").join(then.select(*keys, "value"), keys).select("chrom", "cell", "n_sites", "component", "value", "v"), "components")
        found = own if found is None else found.unionByName(own)
    return found


def components(panels: DataFrame, n: int, k: int = 2, iterations: int = 100, cells: int = PANEL) -> DataFrame:
    """VECTORS of the Gram matrices of n samples."""
    if len(_panels(n, cells)) == 1:
        return panels.mapInArrow(lambda b: _alone(b, n, k, iterations), VECTORS)
    return _rounds(panels, n, k, iterations)


def samples_of(dos: DataFrame) -> np.ndarray:
    """The sample numbers, in order: as many as the cohort has."""
    return np.sort(dos.select("sample_idx").distinct().toArrow().column(0).to_numpy())


def first_component(dos: DataFrame, iterations: int = 100, cells: int = PANEL) -> DataFrame:
    """sample_idx, pc1 (of unit length) and place in its order, over all sites."""
    samples = samples_of(dos)
    got = components(grams(site_vectors(dos), samples, 1, cells), len(samples), 1, iterations, cells)
    ids = F.array(*[F.lit(int(i)) for i in samples]) if len(samples) <= 1000 else F.lit([int(i) for i in samples])
    order = F.array_sort(F.arrays_zip(F.col("v").alias("pc1"), ids.alias("sample_idx")))
    return got.select(F.posexplode(order).alias("place", "x")).select(F.col("x.sample_idx").alias("sample_idx"), F.col("x.pc1").alias("pc1"), "place")


def local_pca(dos: DataFrame, width: int, step: int | None = None, iterations: int = 100, cells: int = PANEL) -> DataFrame:
    """Chrom, start, end, n_sites, sample_idx, pc1, pc2 (scores) for each window; the greatest absolute score of a component
    is positive. width is a multiple of step (width without one)."""
    step = step or width
    if width % step:
        raise ValueError("width must be a multiple of step")
    samples = samples_of(dos)
    got = components(grams(site_vectors(dos, step), samples, width // step, cells), len(samples), 2, iterations, cells)
    sign = F.when(F.array_max("v") >= -F.array_min("v"), 1.0).otherwise(-1.0)
    scale = sign * F.sqrt(F.greatest(F.col("value"), F.lit(0.0)))
    each = got.select("chrom", "cell", "n_sites", "component", scale.alias("scale"), F.posexplode("v").alias("i", "x")).groupBy("chrom", "cell", "i").agg(F.first("n_sites").alias("n_sites"), *[F.max(F.when(F.col("component") == j, F.col("x") * F.col("scale"))).alias(f"pc{j}") for j in (1, 2)])
    names = F.array(*[F.lit(int(i)) for i in samples]) if len(samples) <= 1000 else F.lit([int(i) for i in samples])
    return each.select("chrom", (F.col("cell") * step).alias("start"), (F.col("cell") * step + width - 1).alias("end"), "n_sites", F.get(names, F.col("i")).alias("sample_idx"), "pc1", "pc2")
