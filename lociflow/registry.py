"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from lociflow.plans import ancestry, codons, homologs, popstats, tracks

FLAGSHIP = "pop_pairwise_divergence"
FAMILIES = (popstats, tracks, ancestry, codons, homologs)


def queries() -> dict[str, Callable]:
    return {name: q for m in FAMILIES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in FAMILIES for name, q in m.SQL.items()}
