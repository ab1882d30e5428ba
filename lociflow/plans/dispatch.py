"""Requests: regional statistics by name, and JSON requests to JSON documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import hobs, popstats, relations, scan
from lociflow.sources import writers

STATS = {"theta_pi": "theta_pi", "theta_W": "theta_W", "Tajima_D": "Tajima_D", "Hp": "Hp"}
PAIRS = {"Fst": "FST", "dXY": "dXY", "dA": "dA", "MI": "MI"}


def region_stats(gl: DataFrame, chrom: str, start: int, end: int, what: list[str], groups: DataFrame | None = None) -> DataFrame:
    """One row of the named statistics over one region: names of STATS and PAIRS (by pair of groups), Hobs and HWE; dosage_matrix gives
    the dosages instead. Filters reach the scan of gl."""
    here = gl.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))
    dos = popstats.dosages(here)
    if what == ["dosage_matrix"]:
        return dos.select("chrom", "pos", "sample_idx", "dosage")
    known = {*STATS, *PAIRS, "Hobs", "HWE"}
    if unknown := [w for w in what if w not in known]:
        raise ValueError(f"unknown statistics: {unknown}")
    width = end + 1
    sites = popstats.site_frequencies(dos)
    out = popstats.cohort_diversity(sites, width, width).select("n_sites", *[c for w, c in STATS.items() if w in what])
    if pairs := [w for w in what if w in PAIRS]:
        if groups is None:
            raise ValueError("pairs of groups need groups")
        p = popstats.pairwise_divergence(popstats.group_frequencies(dos, groups), width, width)
        out = out.crossJoin(p.agg(*[F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "group_a", "group_b"), F.col(PAIRS[w])))).alias(w) for w in pairs]))
    if {"Hobs", "HWE"} & set(what):
        r = popstats.region_stats(dos, sites, chrom, start, end)
        out = out.crossJoin(r.select(*(["hobs_mean", "hobs_sd"] if "Hobs" in what else []), *(["hwe_excess"] if "HWE" in what else [])))
    return out


def batch_stats(gl: DataFrame, candidates: DataFrame, groups: DataFrame, arrangements: tuple[str, str] = ("HOM_A", "HOM_B")) -> DataFrame:
    """One row for each candidate: n_sites, theta_pi, theta_W, Tajima_D, Hp, Hobs (mean share of the middle genotype), Fst_a_b and
    dXY_a_b of every pair of groups, and arrangement_FST_like, the Fst of the arrangements (0 without both). Sites meet candidates by bins, then
    each candidate is a window of its own. Candidates without sites keep nulls."""
    from lociflow.operators.windows import points_in

    names = sorted(r[0] for r in groups.select("group").distinct().collect())  # a few
    wide = 1 << 40
    own = candidates.select(F.col("candidate_id").alias("_id"), "chrom", "start", "end")
    dos = points_in(popstats.dosages(gl), own, 100_000).select(F.col("_id").alias("chrom"), "pos", "sample_idx", "dosage", "peak", "het")
    cohort = popstats.cohort_diversity(popstats.site_frequencies(dos), wide, wide).drop("start", "end", "S")
    het = dos.groupBy("chrom").agg(F.avg("het").alias("Hobs"))
    pairs = popstats.pairwise_divergence(popstats.group_frequencies(dos, groups), wide, wide)
    of = lambda a, b, c: F.max(F.when((F.col("group_a") == a) & (F.col("group_b") == b), F.col(c)))
    both = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    flat = pairs.groupBy("chrom").agg(*[of(a, b, c).alias(f"{n}_{a}_{b}") for n, c in (("Fst", "FST"), ("dXY", "dXY")) for a, b in both]) if both else pairs.select("chrom").distinct()
    a, b = sorted(arrangements)
    like = F.coalesce(F.col(f"Fst_{a}_{b}"), F.lit(0.0)) if (a, b) in both else F.lit(0.0)
    out = cohort.join(het, "chrom").join(flat, "chrom", "left").withColumn("arrangement_FST_like", like).withColumnRenamed("chrom", "candidate_id")
    return candidates.select("candidate_id").join(out, "candidate_id", "left")


Handler = Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]


def _outliers(spark: SparkSession, q: dict, t: dict[str, DataFrame]) -> DataFrame:
    way, cut = q.get("direction", "high"), q.get("threshold", 0.25)
    found = scan.flagged(t["track"], cut, way, q.get("top_percent"))
    return scan.regions(found, q.get("merge_gap", 10_000), way, q.get("stronger_threshold", scan.stronger_default(way, q.get("threshold"))))


def _flanks(spark: SparkSession, q: dict, t: dict[str, DataFrame]) -> DataFrame:
    return scan.candidates_against_flanks(t["candidates"], t["track"], q.get("stats", ["stat"]), q.get("flank", 300_000), q.get("exclude_flank_overlaps", False), q.get("permutations", 1000), q.get("seed", 1))


def _xpehh(spark: SparkSession, q: dict, t: dict[str, DataFrame]) -> DataFrame:
    return scan.z_scores(relations.xp_ehh(t["gl"], q["test"], q["ref"], q.get("focal_step", 1), q.get("decay", 0.05), q.get("reach", 1_000_000), smallest=q.get("min_cohort", 20)), "raw")


def _ihs(spark: SparkSession, q: dict, t: dict[str, DataFrame]) -> DataFrame:
    s = relations.ihs(t["gl"], q.get("focal_step", 1), q.get("decay", 0.05), q.get("reach", 1_000_000), smallest=q.get("min_carriers", 8))
    return scan.z_scores(s.withColumn("bin", relations.frequency_bin(F.col("freq"), q.get("bins", 20))), "raw", ["bin"])


def _hobs(spark: SparkSession, q: dict, t: dict[str, DataFrame]) -> DataFrame:
    return hobs.windows(hobs.heterozygosity(t["hwe"]), tuple(map(tuple, q["scales"])) if "scales" in q else hobs.SCALES, q.get("mad_n", 3.0))


def _batch(spark: SparkSession, q: dict, t: dict[str, DataFrame]) -> DataFrame:
    return batch_stats(t["gl"], t["candidates"], t["groups"])


HANDLERS: dict[str, Handler] = {"batch_stats": _batch, "outlier_scan": _outliers, "candidate_vs_flanks": _flanks, "xpehh": _xpehh, "iHS": _ihs, "hobs_windows": _hobs}


def score_metadata(scores: DataFrame) -> dict:
    """What the normalisation of a scan used: n_focal, global_mean and global_sd of its raw scores."""
    r = scores.agg(F.count("raw"), F.avg("raw"), F.stddev_samp("raw")).first()
    return {"n_focal": r[0], "global_mean": r[1], "global_sd": r[2]}


def answer(spark: SparkSession, request: str, tables: dict[str, DataFrame]) -> str:
    """A JSON request {statistic, request_id, params} to its JSON document; with a path, rows are written below it. Errors make a
    document of status error."""
    name, rid = None, None
    try:
        q = json.loads(request)
        name, rid = q.get("statistic"), q.get("request_id")
        if name not in HANDLERS:
            raise ValueError(f"unknown statistic: {name}")
        result = HANDLERS[name](spark, q.get("params", {}), tables)
        meta = score_metadata(result) if name in ("xpehh", "iHS") else None
        if q.get("path"):
            return writers.write_document(result, q["path"], name, rid, meta)
        return writers.document(result, name, rid, meta)
    except (ValueError, KeyError, TypeError) as e:
        return json.dumps({"statistic": name, "request_id": rid, "status": "error", "error": str(e), "rows": []})
