"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each window holds the system turn,
a limited run of the turns before its span, repeated and masked, and the turns of its span; the loss covers
the texts of assistant turns in their own span, so each is learnt once.

The template writes a turn as ``<turn>`` role ``<turn/>`` text ``</turn>``. A backslash goes behind the
``<`` of whatever looks like one of these marks inside a role or text (after any number of backslashes
there), and one is taken off again on reading: the marks themselves never occur inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

OPEN, MIDDLE, CLOSE = "<turn>", "<turn/>", "</turn>"
#: Tokens that the marks of a turn count for.
MARKS = 3


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: its words and single signs inside them, plus the marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + MARKS


def prefix_sums(turns: DataFrame, block: int) -> DataFrame:
    """Adds ``start``, the tokens before each turn in its conversation, in blocks of turn numbers.

    Sums by block give each block's offset, so that a conversation with very many turns isn't sorted in one
    task. Order: turn (nulls first), role, text.
    """
    turns = turns.withColumn("block", F.floor(F.col("turn") / block))
    sums = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    own = turns.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("t")
    same = F.col("t.conv_id").eqNullSafe(F.col("o.conv_id")) & F.col("t.block").eqNullSafe(F.col("o.block"))
    return own.join(offsets.alias("o"), same).select("t.conv_id", "turn", "role", "text", "tokens", (F.col("offset") + F.col("within")).alias("start"))


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 192, block: int = 256) -> DataFrame:
    """Formatted windows of conversations.

    Reads conv_id, turn, role and text; other columns are left alone. Returns conv_id, window (in order, not
    gapless), formatted, loss (array of start and length, in code points, of the texts to learn), repeated
    (how many turns at the head repeat what an earlier window taught or the system turn) and tokens. Null
    role or text counts as empty, a null conv_id is a conversation of its own, and turns with equal numbers
    follow each other by role and text.

    The new turns of a window share a budget of what system turn and history leave. A cell is half of it, and
    a turn belongs to the cell in which it begins, or has a window of its own if it is longer than a cell:
    so no window of several new turns exceeds the budget. A single longer turn isn't cut. An empty table
    gives no rows.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    turns = prefix_sums(turns.withColumn("tokens", turn_tokens(F.col("text"))), block)
    heads = turns.where((F.col("start") == 0) & (F.col("role") == "system")).groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text", "tokens")).alias("head"))
    turns = turns.alias("t").join(heads.alias("h"), F.col("t.conv_id").eqNullSafe(F.col("h.conv_id")), "left").select("t.*", F.coalesce("head.tokens", F.lit(0)).alias("reserve"))
    cell = F.greatest(F.lit(budget - history) - F.col("reserve"), F.lit(budget // 4)) / 2
    turns = turns.withColumn("cell", F.floor(F.col("start") / cell))
    turns = turns.withColumn("window", F.col("cell") * 2 + (F.col("tokens") > cell).cast("long"))
    spans = turns.groupBy("conv_id", "window").agg(F.min("start").alias("from"))
    # the windows after a turn's own that may begin within ``history`` tokens of it
    reach = F.floor((F.col("start") + F.col("tokens") + history) / cell) * 2 + 1
    ahead = turns.where(F.col("tokens") <= history).withColumn("next", F.explode(F.sequence(F.col("window") + 1, F.greatest(reach, F.col("window") + 1))))
    near = F.col("a.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("a.next") == F.col("s.window"))
    again = ahead.alias("a").join(spans.alias("s"), near).where((F.col("start") >= F.col("from") - history) & (F.col("start") < F.col("from")))
    again = again.where(~((F.col("start") == 0) & (F.col("role") == "system"))).select("a.conv_id", F.col("next").alias("window"), "start", "turn", "role", "text", "tokens", F.lit(1).alias("kind"))
    kept = heads.alias("h").join(spans.where(F.col("from") > 0).alias("s"), F.col("h.conv_id").eqNullSafe(F.col("s.conv_id")))
    kept = kept.select("s.conv_id", "window", F.lit(0).cast("long").alias("start"), "head.turn", "head.role", "head.text", "head.tokens", F.lit(0).alias("kind"))
    own = turns.select("conv_id", "window", "start", "turn", "role", "text", "tokens", F.lit(2).alias("kind"))
    rows = own.unionByName(again).unionByName(kept)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    rows = rows.withColumns({"head": head, "written": F.concat(head, body, F.lit(CLOSE)), "body": F.length(body)})
    turn = F.struct("kind", "start", "turn", "role", "text", "written", F.length("head").alias("before"), "body", F.length("written").alias("size"))
    # a window's turns are bounded by its budget
    windows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("tokens").alias("tokens"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    learn = lambda t: (t["kind"] == 2) & (t["role"] == "assistant")
    walk = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(learn(t), F.concat(acc["loss"], F.array(F.struct((acc["at"] + t["before"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        walk["loss"].alias("loss"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("repeated"),
        "tokens",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, by window: turns (array of role and text, repeats left out) and learnt (text)."""
    # behind the last mark nothing is left
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - F.col("repeated") - 1)
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, len(OPEN) + 1, 1 << 30), MIDDLE, 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    learnt = F.transform("loss", lambda x: unescape(F.substr("formatted", x["start"] + 1, x["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows.

    A digest needs the whole conversation in one value; windows have a bounded size, conversations are as
    long as they are.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_windows(windows).select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", told.alias("told"), F.array_join("learnt", "").alias("learnt")).alias("w"))
    whole = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    join = lambda field: F.array_join(F.transform("ws", lambda w: w[field]), "")
    whole = whole.withColumns({"told": join("told"), "learnt": join("learnt")})
    return whole.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(chat_windows(rows.unionByName(extra)))


#: The same rows: digests from the turns themselves, and the windows' lengths by the rules above.
ORACLE = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), tok AS (
  SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 3 AS tokens,
    27 - 7 + length(regexp_replace(role, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) AS chars FROM raw
), pre AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM tok
), head AS (
  SELECT conv_id, tokens AS reserve, chars FROM pre WHERE start = 0 AND role = 'system'
), cel AS (
  SELECT p.*, greatest(832 - coalesce(reserve, 0), 256) / 2.0 AS cell FROM pre p LEFT JOIN head h ON p.conv_id IS NOT DISTINCT FROM h.conv_id
), win AS (
  SELECT *, CAST(floor(start / cell) * 2 AS BIGINT) + CASE WHEN tokens > cell THEN 1 ELSE 0 END AS w FROM cel
), span AS (
  SELECT conv_id, w, min(start) AS f FROM win GROUP BY ALL
), part AS (
  SELECT conv_id, chars FROM win
  UNION ALL SELECT a.conv_id, a.chars FROM win a JOIN span s ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND s.w > a.w
    AND s.w <= greatest(CAST(floor((a.start + a.tokens + 192) / a.cell) * 2 + 1 AS BIGINT), a.w + 1)
    WHERE a.tokens <= 192 AND a.start >= s.f - 192 AND a.start < s.f AND NOT (a.start = 0 AND a.role = 'system')
  UNION ALL SELECT s.conv_id, h.chars FROM head h JOIN span s ON h.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.f > 0
), size AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM part GROUP BY 1
), said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY start, tokens)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY start) FILTER (role = 'assistant'), '') AS learnt FROM win GROUP BY 1
)
SELECT said.conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM said JOIN size ON said.conv_id IS NOT DISTINCT FROM size.conv_id
"""
