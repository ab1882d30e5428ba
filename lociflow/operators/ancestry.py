"""Local ancestry: EM for admixture proportions with fixed frequencies, metrics of Q, and the classifications built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.functions import expr
from lociflow.operators.ranks import cut
from lociflow.operators.windows import numbered, overlap_join, site_windows

FLOOR = 1e-10
#: Fixed colours of up to twelve labels.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#bcbd22", "#17becf", "#aec7e8", "#ffbb78", "#98df8a")


def q_metrics(q: Column) -> dict[str, Column]:
    """P08 of an array of proportions: max_q, delta12, entropy, ena, assigned_pop (1-based, the first on ties), counts above .05 and .10."""
    down = F.sort_array(q, False)
    h = expr.entropy(q, FLOOR)
    return {"max_q": F.array_max(q), "delta12": down[0] - F.coalesce(F.get(down, F.lit(1)), F.lit(0.0)), "entropy": h, "ena": F.exp(h), "assigned_pop": F.array_position(q, F.array_max(q)).cast("int"), "n_above_005": F.size(F.filter(q, lambda x: x > 0.05)), "n_above_010": F.size(F.filter(q, lambda x: x > 0.10))}


def em_proportions(g: np.ndarray, f: np.ndarray, q: np.ndarray, iterations: int = 20, tol: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """Proportions (samples x K) that fit likelihoods g (sites x samples x 3) given frequencies f (sites x K), from a start q; and
    the log-likelihood of each step. Genotype priors are Hardy-Weinberg at each sample's mixed frequency."""
    f = np.clip(f, FLOOR, 1 - FLOOR)
    trace: list[float] = []
    for it in range(1, iterations + 1):
        p = np.clip(f @ q.T, FLOOR, 1 - FLOOR)
        w = g * np.stack([(1 - p) ** 2, 2 * p * (1 - p), p * p], -1)
        total = np.maximum(w.sum(-1), 1e-300)
        mean = (w[..., 1] + 2 * w[..., 2]) / total
        grown = q * ((mean / p).T @ f + ((2 - mean) / (1 - p)).T @ (1 - f))
        grown = np.maximum(grown, FLOOR)
        grown /= grown.sum(1, keepdims=True)
        q = np.clip(grown, FLOOR, 1 - FLOOR)
        q /= q.sum(1, keepdims=True)
        trace.append(float(np.log(total).sum()))
        if it > 2 and abs(trace[-1] - trace[-2]) < tol * abs(trace[-2]):
            break
    return q, trace


def local_q(gl: DataFrame, f: DataFrame, q0: DataFrame, width: int = 100, step: int = 20, iterations: int = 20, tol: float = 1e-4, min_sites: int = 10, default_f: float = 0.25, run: int = 50) -> DataFrame:
    """T01 over windows of `width` sites: chrom, window_id, start, end, n_sites, sample_idx, q (array). f: chrom, pos, f (array) joined by
    site; sites without frequencies get default_f. q0: sample_idx, q (array); samples without get equal shares. Windows are taken by runs of
    `run`, whose sites meet in one task: (run * step + width) x samples numbers; sites are read once and kept as a table."""
    g3 = F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", *[F.greatest(c, F.lit(FLOOR)).alias(c) for c in ("gl0", "gl1", "gl2")]))), lambda x: F.array(x["gl0"], x["gl1"], x["gl2"]))
    packed = cut(gl.groupBy("chrom", "pos").agg(F.flatten(g3).alias("g"), F.collect_set("sample_idx").alias("s")), "sites")
    got = q0.select("sample_idx", "q").toArrow()  # a row for each sample
    start = dict(zip(got.column("sample_idx").to_pylist(), got.column("q").to_pylist(), strict=True))
    k = len(next(iter(start.values()))) if start else 2
    ids = sorted(packed.select(F.explode("s")).distinct().toArrow().column(0).to_pylist())
    first = np.array([start.get(i, [1 / k] * k) for i in ids], float)
    default = F.array(*[F.lit(default_f)] * k)
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - width) / step))
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("_i") - (width - 1)) / step)), F.least(last, F.floor(F.col("_i") / step))
    met = packed.select("chrom", "pos", "g").join(f.select("chrom", "pos", "f"), ["chrom", "pos"], "left").withColumn("f", F.coalesce("f", default))
    at = numbered(packed.select("chrom", "pos"), ["pos"]).filter(lo <= hi).select("chrom", "pos", "_i", last.alias("_last"), F.explode(F.sequence(F.floor(lo / run).cast("long"), F.floor(hi / run).cast("long"))).alias("_run"))
    sites = met.join(at, ["chrom", "pos"])

    def fit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("_i")
        i, pos = t.column("_i").to_numpy(), t.column("pos").to_numpy()
        g, fr = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(i), -1) for c in ("g", "f"))
        chrom, one, m, found = key[0].as_py(), key[1].as_py(), len(ids), []
        for w in range(one * run, min((one + 1) * run - 1, t.column("_last")[0].as_py()) + 1):
            own = slice(*np.searchsorted(i, [w * step, w * step + width]))
            n = own.stop - own.start
            if n < min_sites:
                continue
            q, trace = em_proportions(g[own].reshape(n, m, 3), fr[own], first, iterations, tol)
            found.append((w + 1, pos[own.start], pos[own.stop - 1], n, q, len(trace)))
        if not found:
            return
        each = lambda c, kind: pa.array(np.repeat([x[c] for x in found], m), kind)
        q = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * m * k + 1, k), pa.int32()), pa.array(np.concatenate([x[4] for x in found]).ravel()))
        rows = {"chrom": pa.repeat(pa.scalar(chrom, pa.string()), len(found) * m), "window_id": each(0, pa.int64()), "start": each(1, pa.int64()), "end": each(2, pa.int64()), "n_sites": each(3, pa.int32()), "sample_idx": pa.array(ids * len(found), pa.int32()), "q": q, "iterations": each(5, pa.int32())}
        yield pa.record_batch(list(rows.values()), list(rows))

    return sites.select("chrom", "_run", "_i", "_last", "pos", "g", "f").groupBy("chrom", "_run").applyInArrow(fit, "chrom string, window_id long, start long, end long, n_sites int, sample_idx int, q array<double>, iterations int")


def local_q_summary(samples: DataFrame) -> DataFrame:
    """Mean delta12, entropy, ENA and population sd of delta12 by window, of rows with q."""
    m = q_metrics(F.col("q"))
    return samples.withColumns({c: m[c] for c in ("delta12", "entropy", "ena")}).groupBy("chrom", "window_id", "start", "end", "n_sites").agg(F.avg("delta12").alias("mean_delta12"), F.avg("entropy").alias("mean_entropy"), F.avg("ena").alias("mean_ena"), F.stddev_pop("delta12").alias("sd_delta12"))


def modal_label(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label, the least one on ties."""
    c = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*by).agg(F.max(F.struct("_c", (-F.col(label)).alias("_l") if dict(rows.dtypes)[label] in ("int", "bigint") else F.col("_c").alias("_l"), F.col(label).alias("label"))).alias("_m") if dict(rows.dtypes)[label] in ("int", "bigint") else F.min(F.struct((-F.col("_c")).alias("_c"), F.col(label).alias("label"))).alias("_m")).select(*by, F.col("_m.label").alias("modal"), F.abs("_m._c").alias("count"))


def residual_dosage(dos: DataFrame, f: DataFrame, q: DataFrame) -> DataFrame:
    """Dosage - 2 * sum(q_k f_k) at each site and sample; f joined by site, q by sample."""
    mixed = F.aggregate(F.zip_with("q", "f", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return dos.join(f, ["chrom", "pos"]).join(F.broadcast(q), "sample_idx").select("chrom", "pos", "sample_idx", "dosage", (F.col("dosage") - 2 * mixed).alias("residual"))


def q_support(dos: DataFrame, q: DataFrame) -> DataFrame:
    """Each site's absolute correlation of dosage with every column of q, as shares, with P20 and P21. q: sample_idx, q (array).
    A site needs half of its samples and some variation; missing dosages count as the mean."""
    known = dos.join(F.broadcast(q), "sample_idx")
    n = known.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"), F.count("dosage").alias("valid"), F.avg("dosage").alias("m"), F.stddev_pop("dosage").alias("sd"))
    good = n.filter((F.col("valid") * 2 >= F.col("n")) & (F.col("sd") > 1e-10))
    each = known.join(good.select("chrom", "pos", "m"), ["chrom", "pos"]).select("chrom", "pos", F.coalesce("dosage", "m").alias("d"), "m", F.posexplode("q").alias("k", "x"))
    r = each.groupBy("chrom", "pos", "m", "k").agg(F.abs(F.coalesce(F.corr("d", "x"), F.lit(0.0))).alias("r"))
    arr = r.groupBy("chrom", "pos", "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    s = arr.withColumn("support", F.when(total > 1e-10, F.transform("raw", lambda x: x / total)).otherwise(F.transform("raw", lambda x: F.lit(1.0) / F.size("raw"))))
    m = q_metrics(F.col("support"))
    down = F.sort_array("support", False)
    p = F.col("m") / 2
    out = s.withColumns({"best_q": m["assigned_pop"], "best": m["max_q"], "delta12": m["delta12"], "delta13": down[0] - F.coalesce(F.get(down, F.lit(2)), F.lit(0.0)), "entropy": m["entropy"], "ena": m["ena"], "maf": F.least(p, 1 - p)})
    return out.withColumn("marker_class", marker_class(F.col("best"), F.col("delta12"), F.col("entropy"))).withColumn("confidence", F.when(F.col("best") >= 0.5, "high").when(F.col("best") >= 0.3, "moderate").otherwise("low")).drop("m", "raw")


def with_membership(support: DataFrame, majmin: DataFrame, thin: DataFrame) -> DataFrame:
    """Sites with major_allele and minor_allele of majmin (chrom, pos, major_allele, minor_allele; empty where it has none), and yes or
    no for in_majmin and in_thin500 (thin: chrom, pos)."""
    a = majmin.select("chrom", "pos", "major_allele", "minor_allele", F.lit("yes").alias("in_majmin")).dropDuplicates(["chrom", "pos"])
    b = thin.select("chrom", "pos", F.lit("yes").alias("in_thin500")).distinct()
    j = support.join(a, ["chrom", "pos"], "left").join(b, ["chrom", "pos"], "left")
    return j.withColumns({c: F.coalesce(c, F.lit("")) for c in ("major_allele", "minor_allele")} | {c: F.coalesce(c, F.lit("no")) for c in ("in_majmin", "in_thin500")})


def marker_class(best: Column, delta: Column, h: Column) -> Column:
    return F.when((best >= 0.5) & (delta >= 0.2), "dominant_single_Q").when(best >= 0.5, "dominant_plus_secondary").when(best >= 0.3, "mixed_Q_support").when(h > 1.5, "diffuse").otherwise("low_information")


def support_windows(support: DataFrame, width: int = 50, step: int = 25) -> DataFrame:
    """By window of sites: mean support of each Q, dominant Q and its share, mean entropy, coherence (largest share of a best Q),
    switches of the best Q along the window, and whether support is mixed."""
    w = site_windows(support, width, step, ["pos"])
    seq = Window.partitionBy("chrom", "window_id").orderBy("pos")
    w = w.withColumn("_sw", (F.col("best_q") != F.lag("best_q").over(seq)).cast("int"))
    base = w.groupBy("chrom", "window_id").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_snps"), F.avg("entropy").alias("mean_entropy"), F.coalesce(F.sum("_sw"), F.lit(0)).alias("switches"))
    mean = w.select("chrom", "window_id", F.posexplode("support").alias("k", "s")).groupBy("chrom", "window_id", "k").agg(F.avg("s").alias("s")).groupBy("chrom", "window_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("mean_support"))
    top = w.groupBy("chrom", "window_id", "best_q").agg(F.count(F.lit(1)).alias("c")).groupBy("chrom", "window_id").agg(F.max("c").alias("c"))
    j = base.join(mean, ["chrom", "window_id"]).join(top, ["chrom", "window_id"])
    return j.withColumns({"dominant_q": F.array_position("mean_support", F.array_max("mean_support")).cast("int"), "dominant_share": F.array_max("mean_support"), "coherence": F.col("c") / F.col("n_snps")}).withColumn("mixed", F.col("coherence") < 0.5).drop("c")


def runs(rows: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Blocks of equal labels: by, block (from 1), label, length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = rows.withColumn("_n", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1))
    return new.withColumn("block", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "block", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("length"))


def structure_class(n: Column, labels: Column, dom: Column, switches: Column, halves_differ: Column) -> Column:
    """P22, rules in order."""
    return (F.when(n < 3, "too_sparse").when(labels == 1, "homogeneous").when((dom >= 0.8) & (switches <= 2), "dominant_plus_secondary").when((labels == 2) & dom.between(0.3, 0.7), "two_block_composite")
            .when(switches >= 0.4 * n, "multi_block_fragmented").when((switches <= 2) & (labels <= 3) & halves_differ, "continuous_gradient").when((switches <= 2) & (labels <= 3), "dominant_plus_secondary").otherwise("diffuse_mixed"))


def composition(rows: DataFrame, by: list[str], order: list[str], label: str = "label", numbers: list[str] | None = None, min_rows: int = 3) -> DataFrame:
    """By (parent, sample): label counts and shares, blocks, switches, largest and second block, fragmentation, entropy of shares,
    means of numbers, and the structure class. Groups below min_rows are left out."""
    w = Window.partitionBy(*by)
    half = F.when(F.row_number().over(w.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(w) / 2), 0).otherwise(1)
    halves = rows.withColumn("_h", half).groupBy(*by, "_h", label).agg(F.count(F.lit(1)).alias("_c")).groupBy(*by, "_h").agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(label).alias("l")))["l"].alias("_m")).groupBy(*by).agg((F.max(F.when(F.col("_h") == 0, F.col("_m"))) != F.max(F.when(F.col("_h") == 1, F.col("_m")))).alias("_differ"))
    # numbers are added in the rows' order, so that a mean that lies between two roundings depends on no partitioning; round as SQL does
    so_far = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = rows.select(*by, F.row_number().over(w.orderBy(*order)).alias("_at"), *[f(c).over(so_far).alias(f"_{k}_{c}") for c in numbers or [] for k, f in (("s", F.sum), ("n", F.count))])
    whole = lambda x: F.max_by(x, "_at")
    base = added.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *[(F.round(whole(f"_s_{c}") / F.nullif(whole(f"_n_{c}"), F.lit(0)) * 10_000) / 10_000).alias(f"mean_{c}") for c in numbers or []]).filter(F.col("n_windows") >= min_rows)
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("c")).join(base.select(*by, "n_windows"), by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_labels"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(label).alias("l")))).alias("_l"), F.sum(-(F.col("c") / F.col("n_windows")) * F.log(F.col("c") / F.col("n_windows"))).alias("label_entropy"))
    blocks = runs(rows, by, order, label).groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks"), F.sort_array(F.collect_list("length"), False).alias("_b"))
    j = base.join(counts, by).join(blocks, by).join(halves, by)
    sw, dom = F.col("n_blocks") - 1, -F.col("_l")[0]["c"] / F.col("n_windows")
    return j.select(*by, "n_windows", "n_labels", F.col("_l")[0]["l"].alias("dominant"), F.round(dom, 4).alias("dominant_share"), F.round(F.coalesce(-F.get("_l", F.lit(1))["c"], F.lit(0)) / F.col("n_windows"), 4).alias("second_share"), "n_blocks", sw.alias("switches"), F.col("_b")[0].alias("largest_block"), F.coalesce(F.get("_b", F.lit(1)), F.lit(0)).alias("second_block"), F.round(sw / F.greatest(F.lit(1), F.col("n_windows") - 1), 4).alias("fragmentation"), F.round("label_entropy", 4).alias("label_entropy"), *[f"mean_{c}" for c in numbers or []], structure_class(F.col("n_windows"), F.col("n_labels"), dom, sw, F.coalesce("_differ", F.lit(False))).alias("structure_class"))


def parent_summary(comp: DataFrame, parent: str = "parent") -> DataFrame:
    """Samples by structure class as `a:3; b:1` (classes in order), the most frequent class, and means."""
    c = comp.groupBy(parent, "structure_class").agg(F.count(F.lit(1)).alias("c"))
    top = c.groupBy(parent).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("structure_class").alias("k"))).alias("t"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("structure_class", "c"))), lambda x: F.concat(x["structure_class"], F.lit(":"), x["c"].cast("string"))), "; ").alias("classes"))
    m = comp.groupBy(parent).agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("fragmentation"), 4).alias("mean_fragmentation"), F.round(F.avg("switches"), 4).alias("mean_switches"))
    return m.join(top, parent).select(parent, "n_samples", "classes", F.col("t.k").alias("top_class"), (-F.col("t.c")).alias("top_count"), "mean_fragmentation", "mean_switches")


def candidate_support(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates with the support windows that overlap them (strictly): mean share of the dominant Q, mixed share,
    entropy, coherence, dominant Q, switches of the dominant Q in order, flags and class. Candidates without windows keep nulls."""
    j = overlap_join(candidates.select("candidate_id", "chrom", "start", "end"), windows.select("chrom", "start", "end", "dominant_q", "dominant_share", "mean_entropy", "coherence", F.col("mixed").cast("int").alias("mixed")), 250_000, strict=True)
    w = Window.partitionBy("candidate_id").orderBy("start_r", "end_r")
    j = j.withColumn("_s", (F.col("dominant_q_r") != F.lag("dominant_q_r").over(w)).cast("int"))
    top = j.groupBy("candidate_id", "dominant_q_r").agg(F.count(F.lit(1)).alias("c")).groupBy("candidate_id").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("dominant_q_r").alias("k")))["k"].alias("dominant_q"))
    g = j.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("dominant_share_r").alias("mean_dominant"), F.avg("mixed_r").alias("mixed_share"), F.avg("mean_entropy_r").alias("mean_entropy"), F.avg("coherence_r").alias("mean_coherence"), F.coalesce(F.sum("_s"), F.lit(0)).alias("switches")).join(top, "candidate_id")
    out = candidates.select("candidate_id", "chrom", "start", "end").join(g, "candidate_id", "left")
    dom, mixed, n, sw = F.col("mean_dominant"), F.col("mixed_share"), F.col("n_windows"), F.col("switches")
    return out.withColumns({"coherent_core": F.when(n.isNotNull(), F.when((F.col("mean_coherence") >= 0.7) & (dom >= 0.4), "yes").otherwise("no")), "mixed_background": F.when(n.isNotNull(), F.when(mixed > 0.5, "yes").otherwise("no")), "parasite": F.when(n.isNotNull(), F.when((sw > 0.3 * n) & (mixed > 0.3), "yes").otherwise("no"))}).withColumn("ancestry_class", F.when(n.isNull(), "no_data").when((dom > 0.5) & (mixed < 0.5), "likely_ancestry").otherwise("unclassified"))


def candidate_class(delta12: Column, dominant: Column, mixed: Column) -> Column:
    """P23 with local Q."""
    return F.when((delta12 > 0.6) & (dominant > 0.5), "ancestry_driven").when((delta12 < 0.3) & (mixed > 0.5), "mixed_uncertain").otherwise("structural_candidate")


def label_colour(label: Column, labels: list[str]) -> Column:
    """One of twelve colours by the label's place; grey for others."""
    pairs = [F.lit(x) for i, name in enumerate(labels[: len(PALETTE)]) for x in (name, PALETTE[i])]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit("#999999"))


def best_k(runs_: DataFrame) -> DataFrame:
    """The K of greatest log-likelihood, the least on ties."""
    return runs_.agg(F.max(F.struct("loglik", (-F.col("K")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("K"), F.col("b.loglik").alias("loglik"))


def merge_local_q(windows: DataFrame, summary: DataFrame, k: int) -> DataFrame:
    """Windows with the summary's columns named for K; all chromosomes in one join."""
    cols = {"mean_delta12": "delta12", "mean_entropy": "entropy", "mean_ena": "ena"}
    return windows.join(summary.select("chrom", "window_id", *[F.col(a).alias(f"localQ_{b}_K{k:02d}") for a, b in cols.items()]), ["chrom", "window_id"], "left")
