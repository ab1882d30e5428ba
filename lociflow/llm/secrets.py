"""Secrets by rules and by a battery of randomness tests, in DataFrame functions alone.

Rules find base spans. Beside them every long run of key characters is tested: its encoding is inferred (the least
alphabet that holds its symbols), and three tests ask whether its symbols could be drawn evenly and one by one from that
alphabet: chi-squared for the alphabet's uniformity, the runs above and below its middle, and the serial correlation of
neighbours (of the quarters of the alphabet that they stand in). A run where = or a separator that its encoding lacks stands
inside is tested in pieces.

A token is reported if two things hold. The battery doesn't reject randomness (least p-value of the three, times three, at
ALPHA or above). And ordinary text is rejected: the hypothesis that its symbols are as uneven as those of ordinary text in
that encoding, for which chi-squared is not central; its lower tail is the token's p-value against text. These p-values are
taken over all tokens of the corpus together, and Benjamini and Hochberg's rule, by classes of length, keeps the expected share
of ordinary tokens among those reported at `rate`. So length decides through the tests' power and through its class, not
by a floor. The rule's thresholds come from a histogram of p-values in steps of a tenth of a decade: at most 401 rows a class for
any input.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; an added span that touches a
base span is dropped; equal rows get equal results; texts and tokens of any length are read whole, in about linear time; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.native import indices, let, sha256_hex
from lociflow.llm.storage import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
_KEY = "A-Za-z0-9"
#: A whole run that - and _ don't touch; a run of letters, digits, - and _; a run of letters, digits, + and / with none of these in it; and up to two = at its end.
TOKEN = rf"(?:(?<![{_KEY}+/_-])[{_KEY}+/]{{20,}}+(?![_-])|(?<![{_KEY}_-])[{_KEY}_-]{{20,}}+|(?<![{_KEY}+/])(?![{_KEY}+/]*[+/][{_KEY}_-]{{20}})[{_KEY}+/]{{20,}}+)(?:={{1,2}}(?![{_KEY}+/_=-]))?"
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the least alphabet on: name, pattern, symbols, and the excess of sum(p^2) * size over 1 in even ordinary text.
ENCODINGS = (
    ("hex_lower", "^[0-9a-f]+$", _DIG + "abcdef", 0.6),
    ("hex_upper", "^[0-9A-F]+$", _DIG + "ABCDEF", 0.6),
    ("lower", "^[a-z]+$", _LOW, 0.6),
    ("upper", "^[A-Z]+$", _UP, 0.6),
    ("base32", "^[A-Z2-7]+$", _UP + "234567", 0.9),
    ("lower36", "^[0-9a-z]+$", _DIG + _LOW, 1.1),
    ("upper36", "^[0-9A-Z]+$", _DIG + _UP, 1.1),
    ("alnum", "^[0-9A-Za-z]+$", _UP + _LOW + _DIG, 2.0),
    ("base64", "^[0-9A-Za-z+/]+$", _UP + _LOW + _DIG + "+/", 2.0),
    ("base64url", "^[0-9A-Za-z_-]+$", _UP + _LOW + _DIG + "-_", 2.0),
)
ALPHA = 1e-3
RATE = 0.05
BINS = 400
#: First lengths of the classes in which the rate is kept.
CLASSES = (0, 24, 32, 48)


def running_sums(x: Column) -> Column:
    """The running sums of an array of numbers: in blocks of the root of its size, so that n numbers cost n * root(n) copies."""
    def blocks(b: Column) -> Column:
        part = lambda i: F.slice(x, (i * b + 1).cast("int"), b.cast("int"))
        total = lambda y, start: F.aggregate(y, start, lambda a, v: a + v)
        upto = lambda y, start: F.aggregate(y, F.struct(start.alias("s"), F.array().cast("array<int>").alias("o")), lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["o"], F.array(a["s"] + v)).alias("o")))["o"]
        at = indices(F.ceil(F.size(x) / b))
        return let(upto(F.transform(at, lambda i: total(part(i), F.lit(0))), F.lit(0)), lambda ends: F.flatten(F.transform(at, lambda i: upto(part(i), F.coalesce(F.get(ends, i - 1), F.lit(0))))))

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")), blocks)


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """(start, end, kind, value) of all matches: the text between matches gives their places."""
    def placed(m: Column, p: Column) -> Column:
        ends = running_sums(F.transform(m, lambda x, i: F.length(x) + F.length(p[i])))
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct((e[i] - F.length(x)).alias("start"), e[i].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x.alias("value"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: placed(m, p)))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>"))


def _upper_tail(z: Column) -> Column:
    """P(N > z): the rational approximation of Abramowitz and Stegun (26.2.17) up to 5, the asymptotic form beyond."""
    def tail(z: Column) -> Column:
        a = F.abs(z)
        density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
        near = let(1 / (1 + 0.2316419 * a), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        return let(density * F.when(a < 5, near).otherwise(1 / F.greatest(a, F.lit(1.0))), lambda p: F.when(z >= 0, p).otherwise(1 - p))

    return let(z, tail)


def _even(x: Column, k: Column) -> Column:
    """A chi-squared value with k degrees of freedom as a normal one (Wilson and Hilferty)."""
    return let(2 / (9 * k), lambda v: (F.pow(x / k, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def _times(s: Column, part: Column) -> Column:
    """How often part stands in s; no part here overlaps itself."""
    return (F.length(s) - F.length(F.replace(s, part, F.lit("")))) / F.length(part)


def _counts(s: Column, parts: Column) -> Column:
    return F.transform(parts, lambda p: _times(s, p))


def battery(body: Column, symbols: Column, halves: Column, quarters: Column, excess: Column) -> Column:
    """random: three times the least of the three tests' p-values, 1 at most; text: p against ordinary text. halves and quarters are the
    symbols' halves and quarters of the alphabet as strings of 0 and 1 or 0 to 3. Everything is counted in strings."""
    n, k = F.length(body).cast("double"), F.size(symbols) - 1.0
    squares = F.aggregate(_counts(body, symbols), F.lit(0.0), lambda a, c: a + c * c)

    def of_chi(chi: Column) -> Column:
        shift = n * excess  # not central: k + shift on average, as a scaled chi-squared (Patnaik)
        scale = (k + shift) / (k + 2 * shift)
        return F.struct(_upper_tail(_even(chi, k)).alias("even"), _upper_tail(-_even(chi * scale, (k + shift) * scale)).alias("text"))

    def of_halves(c: Column) -> Column:
        """c: how often 1, 01 and 10 stand."""
        n1, n2 = c[0], n - c[0]
        flips = lambda m: (c[1] + c[2] - m) / F.sqrt(F.greatest(m * (m - 1) / (n - 1), F.lit(1e-9)))
        return F.when((n1 < 1) | (n2 < 1), 0.0).otherwise(2 * _upper_tail(F.abs(let(2 * n1 * n2 / n, flips))))

    def of_quarters(c: Column, q: Column) -> Column:
        """c: how often 0 to 3 and the mixed pairs of _PAIRS stand; the numbers of equal neighbours follow from these."""
        first, last = F.substring(q, 1, 1).cast("double"), F.substring(q, -1, 1).cast("double")
        of = {pair: c[4 + i] for i, pair in enumerate(_PAIRS)}
        same = lambda i: c[i] - (last == i).cast("int") - sum(of[i, j] for j in range(4) if j != i)
        product = sum(i * j * x for (i, j), x in of.items() if i and j) + same(1) + 4 * same(2) + 9 * same(3)

        def serial(m: Column) -> Column:
            spread = c[1] + 4 * c[2] + 9 * c[3] - n * m * m
            shared = product - m * (2 * n * m - first - last) + (n - 1) * m * m
            return let(spread, lambda v: F.when(v <= 1e-9, 0.0).otherwise(2 * _upper_tail(F.abs((shared / v + 1 / n) * F.sqrt(n)))))

        return let((c[1] + 2 * c[2] + 3 * c[3]) / n, serial)

    runs = let(_counts(halves, F.array(*map(F.lit, ("1", "01", "10")))), of_halves)
    serial = let(quarters, lambda q: let(_counts(q, F.array(*map(F.lit, "0123"), *[F.lit(f"{i}{j}") for i, j in _PAIRS])), lambda c: of_quarters(c, q)))
    return let(squares * (k + 1) / n - n, lambda chi: let(of_chi(chi), lambda c: F.struct(F.least(F.lit(1.0), 3 * F.least(c["even"], runs, serial)).alias("random"), c["text"].alias("text"))))


_PAIRS = [(i, j) for i in range(4) for j in range(4) if i != j]


def tested(token: Column) -> Column:
    """(encoding, symbols, random, text); null where no encoding fits. Padding is no symbol."""
    def inferred(body: Column) -> Column:
        branch = None
        for name, pattern, alphabet, excess in ENCODINGS:
            n = len(alphabet)
            value = F.struct(F.lit(name).alias("encoding"), F.array(*map(F.lit, alphabet)).alias("symbols"), F.lit(alphabet).alias("alphabet"), F.lit("".join(str(2 * i // n) for i in range(n))).alias("halves"), F.lit("".join(str(4 * i // n) for i in range(n))).alias("quarters"), F.lit(excess).alias("excess"))
            branch = F.when(F.rlike(body, F.lit(pattern)), value) if branch is None else branch.when(F.rlike(body, F.lit(pattern)), value)

        def test(e: Column) -> Column:
            got = battery(body, e["symbols"], *[F.call_function("translate", body, e["alphabet"], e[x]) for x in ("halves", "quarters")], e["excess"])
            return let(got, lambda t: F.struct(e["encoding"].alias("encoding"), F.length(body).alias("symbols"), t["random"].alias("random"), t["text"].alias("text")))

        return F.when(~F.rlike(body, F.lit("^[0-9]+$")), let(branch, lambda e: F.when(e.isNotNull(), test(e))))

    return let(F.regexp_replace(token, "=+$", ""), inferred)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans by start and kind) and candidates (start, end, encoding, symbols, random, text)."""
    t = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    assign = F.filter(spans_of(F.col("text"), ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    base = F.concat(assign, spans_of(F.col("text"), ACCESS, "access"), spans_of(F.col("text"), HEX, "hex"))
    tokens = F.transform(spans_of(F.col("text"), TOKEN, "random"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tested(s["value"]).alias("test")))
    bare = F.transform(F.array_sort(base), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    kept = F.transform(F.filter(tokens, lambda s: s["test"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *[s["test"][c].alias(c) for c in ("encoding", "symbols", "random", "text")]))
    return t.select("doc_id", bare.alias("base"), kept.alias("candidates"))


def rejection_bin(bins: dict[int, int], rate: float = RATE) -> int:
    """The least bin b such that rejecting all bins from b on keeps the false-discovery rate: 10^(-b/10) <= rate * rejected / all.
    BINS + 1 if there is none."""
    total, beyond, best = sum(bins.values()), 0, BINS + 1
    for b in range(BINS, -1, -1):
        beyond += bins.get(b, 0)
        if beyond and 10 ** (-b / 10) <= rate * beyond / total:
            best = b
    return best


def _bin(c: Column) -> Column:
    """A candidate's bin: 0 where the battery rejects randomness."""
    return F.when(c["random"] < ALPHA, 0).otherwise(F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.greatest(c["text"], F.lit(1e-45))))))).cast("int")


def _class(c: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, CLASSES)), lambda n: n <= c["symbols"]))


def secrets(docs: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, added (spans with their encoding), in order."""
    found, _ = cut(scan(docs, key, text), "secrets")  # texts are read once
    bins: dict[int, dict[int, int]] = {}
    for r in found.select(F.explode("candidates").alias("c")).groupBy(_class(F.col("c")).alias("class"), _bin(F.col("c")).alias("b")).count().collect():  # classes x bins at most
        bins.setdefault(r["class"], {})[r["b"]] = r["count"]
    limits = F.array(*[F.lit(rejection_bin(bins.get(i + 1, {}), rate)) for i in range(len(CLASSES))])
    clear = F.filter("candidates", lambda c: (_bin(c) >= F.element_at(limits, _class(c))) & (c["random"] >= ALPHA) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select("doc_id", "base", clear.alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1).when((a["start"] == b["start"]) & (a["kind"] == b["kind"]), 0).otherwise(1)
    added = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind")))
    base = F.array_sort("base", order)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return got.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), sha256_hex(_joined(base)).alias("base_sha256"), _joined(F.array_sort(F.concat("base", added), order)).alias("spans"), F.size("added").cast("long").alias("n_added"))
