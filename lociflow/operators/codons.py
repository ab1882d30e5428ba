"""Codon statistics: tables of the standard code, pair statistics, and diversity of coding sequences.

The tables of 64 codons and 4096 pairs are built on the driver for a transition weight kappa and broadcast: their size is fixed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import expr

NT = "ACGT"
CODONS = ["".join(c) for c in product(NT, repeat=3)]
#: Fixed: the standard genetic code (NCBI table 1), codons in the order TTT, TTC, TTA, TTG, TCT ... GGG.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMINO = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), STANDARD, strict=True))


def is_transition(a: str, b: str) -> bool:
    return {a, b} in ({"A", "G"}, {"C", "T"})


def _mutants(codon: str, place: int) -> list[str]:
    return [codon[:place] + x + codon[place + 1 :] for x in NT if x != codon[place]]


def synonymous_sites(codon: str, kappa: float = 1.0) -> float:
    """The weighted share of synonymous neighbours, summed over three places. Stops count in the denominator alone."""
    if AMINO[codon] == "*":
        return 0.0
    weight = lambda p, m: kappa if is_transition(codon[p], m[p]) else 1.0
    return sum(sum(weight(p, m) for m in _mutants(codon, p) if AMINO[m] == AMINO[codon]) / (kappa + 2) for p in range(3))


def degeneracy(codon: str, place: int) -> int:
    """How many of three changes are synonymous; -1 for a stop."""
    return -1 if AMINO[codon] == "*" else sum(AMINO[m] == AMINO[codon] for m in _mutants(codon, place))


def fourfold(codon: str) -> bool:
    """Whether any third nucleotide gives the same amino acid."""
    kin = {AMINO[codon[:2] + x] for x in NT}
    return len(kin) == 1 and "*" not in kin


def substitutions(a: str, b: str, kappa: float = 1.0) -> tuple[float, float, float, float]:
    """Synonymous transitions and transversions, other transitions and transversions: means over all orders of the changes,
    weighted by kappa for each transition; orders through a stop are left out."""
    if a == b or "*" in (AMINO[a], AMINO[b]):
        return 0.0, 0.0, 0.0, 0.0
    total, sums = 0.0, [0.0] * 4
    places = [p for p in range(3) if a[p] != b[p]]
    for order in permutations(places):
        now, weight, found = a, 1.0, [0.0] * 4
        for p in order:
            nxt = now[:p] + b[p] + now[p + 1 :]
            if AMINO[nxt] == "*":
                weight = 0.0
                break
            ts = is_transition(now[p], b[p])
            if len(places) > 1:
                weight *= kappa if ts else 1.0
            found[(0 if AMINO[nxt] == AMINO[now] else 2) + (0 if ts else 1)] += 1
            now = nxt
        total += weight
        sums = [s + weight * f for s, f in zip(sums, found, strict=True)]
    return tuple(s / total for s in sums) if total else (0.0,) * 4


def pair_rows(kappa: float = 1.0) -> list[tuple]:
    """All pairs of codons without stops: a, b, mean synonymous sites, sd_ts, sd_tv, nd_ts, nd_tv, 4-fold site, difference, transition."""
    good = [c for c in CODONS if AMINO[c] != "*"]
    s = {c: synonymous_sites(c, kappa) for c in good}
    out = []
    for a in good:
        for b in good:
            four = fourfold(a) and fourfold(b) and a[:2] == b[:2]
            out.append((a, b, (s[a] + s[b]) / 2, *substitutions(a, b, kappa), int(four), int(four and a[2] != b[2]), int(four and a[2] != b[2] and is_transition(a[2], b[2])), sum(is_transition(x, y) for x, y in zip(a, b, strict=True)), sum(x != y and not is_transition(x, y) for x, y in zip(a, b, strict=True))))
    return out


def codons_of(seq: Column) -> Column:
    """Codons of a sequence, upper case, U as T; a tail of one or two is dropped."""
    return F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(?s)..."), F.lit(0))


SUMS = ("s", "sd_ts", "sd_tv", "nd_ts", "nd_tv", "f4", "d4", "ts4", "ts", "tv")


def pair_sums(pairs: DataFrame, kappa: float = 1.0) -> DataFrame:
    """pair_id, n_bp, numbers of codons (all, with a gap, used) and sums of SUMS over used ones. Pairs of unequal length are left out. Codons
    are counted by kind of pair where sequences lie: no codon becomes a row."""
    weights, known = np.zeros((4096, len(SUMS))), np.zeros(4096, bool)
    at = {c: i for i, c in enumerate(CODONS)}
    for r in pair_rows(kappa):
        known[at[r[0]] * 64 + at[r[1]]] = True
        weights[at[r[0]] * 64 + at[r[1]]] = r[2:]
    letter = np.full(256, 4, np.uint8)
    for i, c in enumerate((b"A", b"C", b"G", b"TU")):
        letter[list(c)] = i

    def codes(seq: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a sequence's codons, and which of them are of four letters; a tail of one or two is dropped."""
        x = letter[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]  # a byte for each code point
        x = x[: len(x) // 3 * 3].reshape(-1, 3)
        return (x[:, 0].astype(np.int64) * 4 + x[:, 1]) * 4 + x[:, 2], (x < 4).all(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = np.zeros((batch.num_rows, 3), np.int64), np.zeros((batch.num_rows, len(SUMS)))
            for i, (x, y) in enumerate(zip(batch.column("_x"), batch.column("_y"), strict=True)):
                (a, good_a), (b, good_b) = codes(x.as_py()), codes(y.as_py())
                n = min(len(a), len(b))
                good = good_a[:n] & good_b[:n]
                seen = np.bincount(a[:n][good] * 64 + b[:n][good], minlength=4096)
                counts[i] = len(a), len(a) - good.sum(), seen[known].sum()
                sums[i] = seen @ weights
            yield pa.record_batch([batch.column("pair_id"), batch.column("n_bp"), *[pa.array(c) for c in counts.T], *[pa.array(c) for c in sums.T]], ["pair_id", "n_bp", "_all", "_gap", "_used", *SUMS])

    same = pairs.filter(F.length("seq_a") == F.length("seq_b")).select("pair_id", F.length("seq_a").alias("n_bp"), F.upper("seq_a").alias("_x"), F.upper("seq_b").alias("_y"))
    kind = dict(same.dtypes)["pair_id"]
    return same.mapInArrow(run, f"pair_id {kind}, n_bp int, _all long, _gap long, _used long, " + ", ".join(f"{c} double" for c in SUMS))


def estimate_kappa(pairs: DataFrame) -> float:
    """From transitions and transversions over all codons; 2 where it is not defined."""
    r = pair_sums(pairs).agg(F.coalesce(F.sum("_used"), F.lit(0)), F.sum("ts"), F.sum("tv")).first()
    sites = 3 * r[0]
    if sites < 10:
        return 2.0
    p, q = r[1] / sites, r[2] / sites
    if 1 - 2 * p - q <= 0 or 1 - 2 * q <= 0:
        return 2.0
    bt = -0.25 * log(1 - 2 * q)
    k = (-0.5 * log(1 - 2 * p - q) - bt) / bt if bt > 0 else 0.0
    return k if k > 0 else 2.0


def pair_statistics(pairs: DataFrame, method: str = "NG86", kappa: float = 1.0) -> DataFrame:
    """pair_id and its codon counts, sites, differences, distances, omega and 4-fold distance."""
    sums, whole = ["s", "sd_ts", "sd_tv", "nd_ts", "nd_tv"], ["f4", "d4", "ts4"]
    g = pair_sums(pairs, kappa).groupBy("pair_id", "n_bp").agg(F.sum("_all").alias("n_codons_total"), F.sum("_gap").alias("n_codons_gap"), F.sum("_used").alias("n_codons_used"), *[F.round(F.sum(c), 9).alias(c) for c in sums], *[F.sum(c).cast("long").alias(c) for c in whole])
    sites, other = F.col("s"), 3.0 * F.col("n_codons_used") - F.col("s")
    sd, nd = F.col("sd_ts") + F.col("sd_tv"), F.col("nd_ts") + F.col("nd_tv")
    share = lambda x, n: F.when(n > 0, x / n)
    if method == "NG86":
        ds, dn = expr.jc69(share(sd, sites)), expr.jc69(share(nd, other))
        d4 = expr.jc69(share(F.col("d4"), F.col("f4")))
    else:
        ds, dn = expr.k80(share(F.col("sd_ts"), sites), share(F.col("sd_tv"), sites)), expr.k80(share(F.col("nd_ts"), other), share(F.col("nd_tv"), other))
        d4 = expr.k80(share(F.col("ts4"), F.col("f4")), share(F.col("d4") - F.col("ts4"), F.col("f4")))
    out = g.select("pair_id", "n_bp", "n_codons_total", "n_codons_gap", (F.col("n_codons_total") - F.col("n_codons_gap") - F.col("n_codons_used")).alias("n_codons_stop"), "n_codons_used", sites.alias("S"), other.alias("N_sites"), sd.alias("sd"), nd.alias("nd"), share(sd, sites).alias("pS"), share(nd, other).alias("pN"), ds.alias("dS"), dn.alias("dN"), F.col("f4").alias("n_4d_sites"), F.col("d4").alias("n_4d_diffs"), share(F.col("d4"), F.col("f4")).alias("p4d"), d4.alias("d4d"))
    return out.withColumn("omega", F.when(expr.finite(F.col("dS")).isNotNull() & (F.col("dS") > 0), F.col("dN") / F.col("dS")))


def codon_diversity(haps: DataFrame, by: list[str]) -> DataFrame:
    """A26 at each codon of a group: mean S, pair means of sd and nd, and 0- and 4-fold sites with their mean differences. haps: by, hap_ord,
    seq. Codons are counted by group and place; at most 61 counts meet for a place, whatever the number of haplotypes. The
    first valid haplotype's codon decides degeneracy."""
    good = [c for c in CODONS if AMINO[c] != "*"]
    at = {c: i for i, c in enumerate(good)}
    s = np.array([synonymous_sites(c) for c in good])
    subs = np.array([[substitutions(a, b) for b in good] for a in good])
    sd, nd = subs[..., :2].sum(-1), subs[..., 2:].sum(-1)
    deg = np.array([[degeneracy(c, p) for p in range(3)] for c in good])
    nts = np.array([[NT.index(x) for x in c] for c in good])
    known = haps.select(*by, "hap_ord", F.posexplode(codons_of(F.col("seq"))).alias("codon_no", "codon")).filter(F.col("codon").isin(good))
    counts = known.groupBy(*by, "codon_no", "codon").agg(F.count(F.lit(1)).alias("n"), F.min("hap_ord").alias("o"))
    places = counts.groupBy(*by, "codon_no").agg(F.collect_list(F.struct("codon", "n")).alias("h"), F.min(F.struct("o", "codon"))["codon"].alias("ref")).filter(F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= 2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.zeros((len(f), len(good)))
            for i, h in enumerate(f["h"]):
                for r in h:
                    x[i, at[r["codon"]]] = r["n"]
            n = x.sum(1)
            pairs = n * (n - 1) / 2
            out = f[[*by, "codon_no"]].copy()
            out["s"] = x @ s / n
            out["sd"] = ((x @ sd) * x).sum(1) / 2 / pairs
            out["nd"] = ((x @ nd) * x).sum(1) / 2 / pairs
            ref = deg[[at[c] for c in f["ref"]]]
            diff = np.stack([(n * n - sum((x @ (nts[:, p] == v)) ** 2 for v in range(4))) / 2 / pairs for p in range(3)], 1)
            for name, d in (("4", 3), ("0", 0)):
                out["n" + name], out["d" + name] = (ref == d).sum(1).astype(float), (diff * (ref == d)).sum(1)
            yield out

    schema = ", ".join(f"{c} {t}" for c, t in places.dtypes if c in [*by, "codon_no"])
    return places.mapInPandas(run, schema + ", s double, sd double, nd double, n4 double, d4 double, n0 double, d0 double")


def diversity(codons: DataFrame, by: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """piS, piN, pi4, pi0 and their ratios by group, divided by the locus' coverage factor (1 where unknown)."""
    g = codons.groupBy(*by).agg(F.count(F.lit(1)).alias("n_codons"), *[F.sum(c).alias(c) for c in ("s", "sd", "nd", "n4", "d4", "n0", "d0")])
    div = lambda a, b: F.when(b > 0, a / b)
    n = 3.0 * F.col("n_codons") - F.col("s")
    p = {"pi_S": div(F.col("sd"), F.col("s")), "pi_N": div(F.col("nd"), n), "pi_4": div(F.col("d4"), F.col("n4")), "pi_0": div(F.col("d0"), F.col("n0"))}
    out = g.select(*by, "n_codons", *[v.alias(k) for k, v in p.items()]).withColumn("pi_NS", div(F.col("pi_N"), F.col("pi_S"))).withColumn("pi_04", div(F.col("pi_0"), F.col("pi_4")))
    if coverage is None:
        return out
    factor = F.coalesce(F.when(F.col("factor") > 0, F.col("factor")), F.lit(1.0))
    return out.join(coverage, by[0], "left").withColumns({k + "_corrected": F.col(k) / factor for k in p}).withColumn("factor", factor)


def codon_bootstrap(codons: DataFrame, by: list[str], replicates: int = 1000, seed: str = "codon") -> DataFrame:
    """Intervals of piS, piN, pi4, pi0 over codons drawn again. Each codon has its own number of draws in each replicate (Poisson, mean
    1, seeded by its group and place), so that replicates are sums, made where the codons lie; nothing is sorted or joined."""
    sums = ("n", "s", "sd", "nd", "n4", "d4", "n0", "d0")
    seeds = codons.withColumn("n", F.lit(1.0)).withColumn("_seed", F.xxhash64(F.lit(seed), *by, "codon_no"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        keys: dict[tuple, list] = {}
        for f in frames:
            for at in range(0, len(f), 2_000):  # weights of 2,000 codons at once
                part = f.iloc[at : at + 2_000]
                draws = np.stack([np.random.Generator(np.random.Philox(int(x) & 0xFFFFFFFFFFFFFFFF)).poisson(1.0, replicates) for x in part["_seed"]]).astype(float)
                values = part[list(sums)].to_numpy(float)
                for key, rows in part.groupby(by, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    got = draws[rows].T @ values[rows]
                    total[key] = total[key] + got if key in total else got
                    keys.setdefault(key, [part[c].iloc[rows[0]] for c in by])
            if len(total) > 500:  # as much as is kept at once
                yield from _replicates(total, keys)
        yield from _replicates(total, keys)

    def _replicates(total: dict, keys: dict) -> Iterator[pd.DataFrame]:
        for key, x in total.items():
            yield pd.DataFrame({**dict(zip(by, ([v] * replicates for v in keys[key]), strict=True)), "_rep": np.arange(replicates), **{c: x[:, i] for i, c in enumerate(sums)}})
        total.clear()

    kinds = ", ".join(f"{c} {t}" for c, t in codons.dtypes if c in by)
    drawn = seeds.select(*by, "_seed", *sums).mapInPandas(run, f"{kinds}, _rep long, " + ", ".join(f"{c} double" for c in sums))
    whole = drawn.groupBy(*by, "_rep").agg(*[F.sum(c).alias(c) for c in sums])
    share = lambda a, b: F.when(b > 0, a / b)
    stats = {"pi_S": share(F.col("sd"), F.col("s")), "pi_N": share(F.col("nd"), 3 * F.col("n") - F.col("s")), "pi_4": share(F.col("d4"), F.col("n4")), "pi_0": share(F.col("d0"), F.col("n0"))}
    lists = whole.groupBy(*by).agg(*[F.sort_array(F.collect_list(v)).alias(k) for k, v in stats.items()])  # as many values as replicates
    place = lambda k, q: F.get(k, F.floor(q * (F.size(k) - 1) + 0.5).cast("int"))
    return lists.select(*by, *[place(F.col(k), q).alias(f"{k}_{name}") for k in stats for q, name in ((0.025, "lo"), (0.975, "hi"))])
