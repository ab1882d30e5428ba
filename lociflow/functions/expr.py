"""Scalar expressions of the statistics, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed coefficients of the public Chebyshev fit of erfc (Numerical Recipes), relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c if c != ERFC[-1] else F.lit(c)
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2.0 - r)


def normal_p(z: Column) -> Column:
    """Two-sided tail of a normal."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi2_p(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def sql_erfc(x: str) -> str:
    """The same expression in SQL."""
    t = f"(1.0::double/(1.0::double+0.5::double*abs({x})))"
    poly = f"{ERFC[-1]}::double"
    for c in reversed(ERFC[:-1]):
        poly = f"({poly}*{t}+({c}::double))"
    return f"(case when {x}>=0 then {t}*exp(-({x})*({x})+{poly}) else 2.0::double-{t}*exp(-({x})*({x})+{poly}) end)"


def finite(x: Column) -> Column:
    """NaN and infinities are missing."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number(text: Column) -> Column:
    """A cell of a text table: NA, nan, empty and infinite are missing."""
    return finite(F.nullif(F.trim(text), F.lit("")).try_cast("double"))


def jc69(p: Column) -> Column:
    """Jukes-Cantor distance of a share of differences; infinite at saturation, missing below 0."""
    return F.when(p.isNull() | F.isnan(p) | (p < 0), None).when(p >= 0.75, float("inf")).otherwise(-0.75 * F.log(1 - 4 * p / 3))


def k80(ts: Column, tv: Column) -> Column:
    """Kimura distance of shares of transitions and transversions; infinite where an argument is not positive."""
    a, b = 1 - 2 * ts - tv, 1 - 2 * tv
    return F.when(ts.isNull() | tv.isNull(), None).when((a <= 0) | (b <= 0), float("inf")).otherwise(-0.5 * F.log(a) - 0.25 * F.log(b))


def entropy(q: Column, floor: float = 1e-10) -> Column:
    """-sum q ln q of an array, values floored."""
    return F.aggregate(q, F.lit(0.0), lambda a, x: a - F.greatest(x, F.lit(floor)) * F.log(F.greatest(x, F.lit(floor))))


def fis_label(f: Column, threshold: float = 0.10) -> Column:
    return F.when(f <= -threshold, "HET_excess").when(f >= threshold, "HET_deficit").otherwise("HWE_like")


def passes(v: Column, threshold: Column | float, direction: str = "high") -> Column:
    """Direction-aware test of a value; missing and infinite values fail."""
    t = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    kind = {"high": "high", "upper": "high", "low": "low", "lower": "low", "abs": "abs", "two_sided": "abs"}[direction]
    hit = {"high": v >= t, "low": v <= t, "abs": F.abs(v) >= t}[kind]
    return F.coalesce(finite(v).isNotNull() & hit, F.lit(False))


def sample_id(path: Column) -> Column:
    """A sample's name: the file's base name without the suffixes of alignments."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]+$", 0), r"(\.sorted)?(\.markdup)?\.(bam|cram)$", "")


def karyotype_state(text: Column) -> Column:
    """0, 1, 2 for the names of the three karyotypes; null for others."""
    u = F.upper(F.trim(text))
    return F.when(u.isin("HOM_A", "HOM_STD", "0"), 0).when(u.isin("HET", "1"), 1).when(u.isin("HOM_B", "HOM_INV", "2"), 2)


def hash_int(text: Column) -> Column:
    """32 bits of md5: the same number in other engines."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def log10_1p(x: Column) -> Column:
    """log10(x + 1), for counts on a colour scale."""
    return F.log10(x + 1)


def segment(mid: Column, start: Column, end: Column) -> Column:
    """Where a midpoint stands to a candidate, rules in order."""
    half = (start + end) / 2
    return F.when(mid < start, "Left flank").when(mid < half, "Inv. left half").when(mid <= end, "Core").when(mid <= end + (end - start) * 0.5, "Inv. right half").otherwise("Right flank")


def common_columns(a: list[str], b: list[str]) -> list[str]:
    """The names of a that b has too, in the order of a."""
    return [c for c in a if c in set(b)]
