"""Chat formatting in budgeted windows, in DataFrame functions alone.

Every turn becomes  <|im_start|>role NEWLINE text <|im_end|> NEWLINE.  Control strings inside texts and roles are broken by
a backslash after their first character, and backslashes are doubled; removing one backslash before any character
undoes both. Prefix sums of turn tokens choose windows of whole turns within a token budget. A window after the first
starts with the conversation's system turn and with up to `history` turns repeated from before it, as far as
`history_budget` holds them. The loss mask covers the texts of assistant turns in the window where they are new: repeated
ones are masked out, so that each is a target once. A turn above the budget has a window of its own and stays whole.

Defined results: null texts and roles are empty; turns are ordered by turn, role and text, nulls first, and repeated rows
are turns of their own; null conv_id is a conversation; an empty table gives an empty result; other columns are ignored.
A conversation is one row of the output and so must fit a row; its turns are summed and sorted by the shuffle, not in
memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.native import indices, let, sha256_hex

START, END = "<|im_start|>", "<|im_end|>\n"
#: Fixed control strings of public chat templates.
CONTROL = r"(<|\[)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
BUDGET, HISTORY, HISTORY_BUDGET = 512, 2, 128
_ROLE = r"([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)"
TURN = r"(?s)<\|im_start\|>" + _ROLE + r"\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(piece: Column) -> Column:
    """A token for each four bytes, rounded up."""
    return F.ceil(F.octet_length(piece) / 4).cast("long")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant", system: str = "system") -> DataFrame:
    """conv_id and windows: an array of (text, first, start, end, repeated, loss). Turns start..end-1 are new in a window,
    `repeated` turns stand before them, and loss has (start, length) of each target in code points of text."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = base.select("conv_id", "turn", "role", "text", F.length(head).alias("h"), escape(F.col("text")).alias("body"), head.alias("head")).select("conv_id", "turn", "role", "text", "h", F.length("body").alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = made.withColumn("i", F.row_number().over(order)).withColumn("t", F.sum(token_count(F.col("piece"))).over(upto)).withColumn("c", F.sum(F.length("piece").cast("long")).over(upto))
    rows = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "role", "h", "n", "piece", "t", "c"))).alias("r"))

    def tokens(r: Column, a: Column, b: Column) -> Column:
        """Tokens of turns a..b-1: a difference of prefix sums."""
        return F.when(b > 0, r[b - 1]["t"]).otherwise(0) - F.when(a > 0, r[a - 1]["t"]).otherwise(0)

    def windows(r: Column) -> Column:
        sys = F.when(r[0]["role"] == system, 1).otherwise(0)

        def back(i: Column) -> Column:
            """How many turns before turn i are repeated."""
            return F.array_max(F.filter(F.sequence(F.lit(0), F.lit(history)), lambda k: (i - k >= sys) & (tokens(r, F.greatest(i - k, F.lit(0)), i) <= history_budget)))

        def step(acc: Column, i: Column) -> Column:
            own = tokens(r, i, i + 1)
            fresh = (F.size(acc["starts"]) == 0) | (acc["used"] + own > budget)
            k = F.coalesce(back(i), F.lit(0))
            again = tokens(r, F.lit(0), sys) + tokens(r, F.greatest(i - k, F.lit(0)), i) + own
            return F.when(fresh, F.struct(F.concat(acc["starts"], F.array(i)).alias("starts"), F.when(F.size(acc["starts"]) == 0, own).otherwise(again).cast("long").alias("used"))).otherwise(F.struct(acc["starts"].alias("starts"), (acc["used"] + own).cast("long").alias("used")))

        start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used"))
        starts = F.aggregate(indices(F.size(r)), start, step)["starts"]

        def window(starts: Column, w: Column) -> Column:
            s = starts[w]
            e = F.coalesce(F.get(starts, w + 1), F.size(r))
            return let(F.when(w == 0, F.lit(0)).otherwise(F.coalesce(back(s), F.lit(0))), lambda k: let(s - k, lambda first: let(F.when((first > 0) & (sys == 1) & (w > 0), 1).otherwise(0), lambda keep: F.struct(
                F.concat(F.when(keep == 1, r[0]["piece"]).otherwise(""), F.array_join(F.transform(F.slice(r, first + 1, e - first), lambda x: x["piece"]), "")).alias("text"),
                first.alias("first"), s.alias("start"), e.alias("end"), (keep + k).alias("repeated"),
                F.transform(F.filter(F.slice(r, s + 1, e - s), lambda x: x["role"] == target), lambda x: F.struct(
                    (F.when(keep == 1, r[0]["c"]).otherwise(0) + F.when(x["i"] > 1, F.get(r, x["i"] - 2)["c"]).otherwise(0) - F.when(first > 0, F.get(r, first - 1)["c"]).otherwise(0) + x["h"]).cast("int").alias("start"), x["n"].alias("length"))).alias("loss")))))

        return let(starts, lambda st: F.transform(indices(F.size(st)), lambda w: window(st, w)))

    return rows.select("conv_id", let(F.col("r"), windows).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; repeated ones left out), loss_text and formatted_chars, from the windows' texts and masks."""
    def turns(w: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(w["text"], F.lit(TURN), F.lit(1)).alias("role"), F.regexp_extract_all(w["text"], F.lit(TURN), F.lit(2)).alias("text"))
        return F.transform(F.slice(both, w["repeated"] + 1, F.size(both)), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))

    loss = F.array_join(F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["start"] + 1, s["length"]))))), "")
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.length(w["text"]))
    return formatted.select("conv_id", F.flatten(F.transform("windows", turns)).alias("turns"), loss.alias("loss_text"), chars.alias("formatted_chars"))


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose two turns consist of control strings."""
    kinds = dict(turns.dtypes)
    probe = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_back(format_windows(with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha256_hex(F.col("loss_text")).alias("loss_sha256"), "formatted_chars")


_BACK = f"""coalesce(CASE WHEN i - {HISTORY} >= sys AND tb - coalesce((SELECT sum(x.t) FROM p x WHERE x.conv_id = p.conv_id AND x.i < p.i - {HISTORY}), 0) <= {HISTORY_BUDGET} THEN {HISTORY} END,
 CASE WHEN i - 1 >= sys AND tb - coalesce((SELECT sum(x.t) FROM p x WHERE x.conv_id = p.conv_id AND x.i < p.i - 1), 0) <= {HISTORY_BUDGET} THEN 1 END, 0)"""
SQL = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '{CONTROL}', '\\1\\\\\\2', 'g') AS body, replace(regexp_replace(replace(role, chr(92), chr(92) || chr(92)), '{CONTROL}', '\\1\\\\\\2', 'g'), chr(10), chr(92) || chr(10)) AS head FROM r),
q AS (SELECT *, '{START}' || head || chr(10) || body || '<|im_end|>' || chr(10) AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM e),
p AS (SELECT conv_id, i, role, text, ceil(octet_length(encode(piece)) / 4.0)::BIGINT AS t, length(piece) AS c, coalesce(sum(ceil(octet_length(encode(piece)) / 4.0)::BIGINT) OVER w, 0) AS tb, coalesce(sum(length(piece)) OVER w, 0) AS cb,
  max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys, max(CASE WHEN i = 0 THEN ceil(octet_length(encode(piece)) / 4.0)::BIGINT END) OVER (PARTITION BY conv_id) AS t0, max(CASE WHEN i = 0 THEN length(piece) END) OVER (PARTITION BY conv_id) AS c0
  FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, {_BACK} AS k FROM p),
a AS (SELECT b.*, CASE WHEN sys = 1 THEN t0 ELSE 0 END + tb - (SELECT x.tb FROM p x WHERE x.conv_id = b.conv_id AND x.i = b.i - b.k) + t AS again FROM b),
g AS (SELECT conv_id, i, t AS used, true AS fresh FROM a WHERE i = 0
  UNION ALL SELECT a.conv_id, a.i, CASE WHEN g.used + a.t > {BUDGET} THEN a.again ELSE g.used + a.t END, g.used + a.t > {BUDGET} FROM g JOIN a ON a.conv_id IS NOT DISTINCT FROM g.conv_id AND a.i = g.i + 1),
w AS (SELECT a.*, CASE WHEN a.i = 0 THEN 0 ELSE a.k END AS kk, lead(a.cb) OVER (PARTITION BY a.conv_id ORDER BY a.i) AS next_ FROM g JOIN a ON a.conv_id IS NOT DISTINCT FROM g.conv_id AND a.i = g.i WHERE fresh),
z AS (SELECT conv_id, sum(c) AS total FROM p GROUP BY conv_id),
f AS (SELECT w.conv_id, sum(CASE WHEN w.i - kk > 0 AND sys = 1 THEN c0 ELSE 0 END + coalesce(next_, total) - (SELECT x.cb FROM p x WHERE x.conv_id = w.conv_id AND x.i = w.i - kk))::BIGINT AS formatted_chars FROM w JOIN z ON z.conv_id = w.conv_id GROUP BY w.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM d JOIN f USING (conv_id)
"""
