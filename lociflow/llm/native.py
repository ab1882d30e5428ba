"""Column helpers for operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII alone take the short way."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out, i = [], 0
    while len(out) < n:
        if f"_c{i}_" not in taken:
            out.append(f"_c{i}_")
        i += 1
    return out


def named(column: str) -> Column:
    """The column of that very name, whatever stands in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_key(key: Column, text: Column) -> Column:
    """A row's name in hashes: its id and the digest of its text, so that rows without an id, or with the same one, go apart."""
    return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def md5_bits(key: Column, seed: str, digits: int) -> Column:
    """The first 4 * digits bits of md5(seed:key) as a number: the same in other engines. Null hashes like the empty string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, digits), 16, 10).cast("long")
