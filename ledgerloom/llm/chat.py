"""Chat formatting: conversations as budgeted, turn-aligned training windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Marks of the template and of other common ones. Fixed values.
START, END = "<|im_start|>", "\n<|im_end|>\n"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>"

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
SPREAD = 1024


def escaped(text: Column) -> Column:
    """A backslash more before each control string, so that none is left bare."""
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def text_tokens(text: Column) -> Column:
    """An upper estimate of tokens from bytes, and the marks of a turn."""
    return (F.ceil(F.octet_length(text) / 4) + 6).cast("bigint")


def _numbered(turns: DataFrame) -> DataFrame:
    """``idx`` from 1, tokens ``before`` each turn, and ``sys``, ``sys_tokens`` of the conversation.

    Works in stretches of ``SPREAD`` turns, so that one long conversation is
    numbered by many tasks; only a row per stretch meets in one.
    """
    turns = turns.withColumn("_part", F.floor(F.col("turn") / SPREAD))
    inside = Window.partitionBy("conv_id", "_part").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({
        "_in": F.row_number().over(inside),
        "_upto": F.sum("tokens").over(running),
    })
    is_system = F.when(F.col("role") == "system", F.col("_in"))
    parts = turns.groupBy(F.col("conv_id").alias("_conv"), F.col("_part").alias("_stretch")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("tokens").alias("_t"),
        F.min(is_system).alias("_s"), F.min_by("tokens", is_system).alias("_st"))
    in_order = Window.partitionBy("_conv").orderBy(F.col("_stretch").asc_nulls_last())
    ahead = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumns({
        "_rows": F.coalesce(F.sum("_n").over(ahead), F.lit(0)),
        "_tokens": F.coalesce(F.sum("_t").over(ahead), F.lit(0)),
    }).withColumns({
        "sys": F.first(F.col("_rows") + F.col("_s"), ignorenulls=True).over(whole),
        "sys_tokens": F.first("_st", ignorenulls=True).over(whole),
    })
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_part").eqNullSafe(F.col("_stretch"))
    return turns.join(parts, same).select(
        "conv_id", "role", "text", "tokens", "sys", "sys_tokens",
        (F.col("_rows") + F.col("_in")).cast("bigint").alias("idx"),
        (F.col("_tokens") + F.col("_upto") - F.col("tokens")).alias("before"))


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    tokens=text_tokens,
) -> DataFrame:
    """Formatted windows: conv_id, window, formatted, n_tokens, first_turn, n_repeated, n_new, loss.

    Needs conv_id, turn, role and text; other columns are not carried. A window has
    the conversation's first system turn, up to ``history_turns`` turns before it
    within ``history_tokens``, and its own turns, whole and in order. The prefix
    sum of tokens is cut every half of the room that is left: turns that start in
    a piece share a window, and one larger than a piece has its own, so no
    window exceeds ``budget`` unless a single turn does. A system turn above half
    the budget is not repeated.

    ``loss`` lists (start, length), in code points of ``formatted``, of the
    escaped texts of the window's own assistant turns. Repeated turns, the first
    ``n_repeated`` of a window, are never targets, so each assistant text is one
    exactly once.

    Null texts and roles are empty; null turns come last; turns of equal number
    are ordered by role and text, and repeated rows are turns of their own; a
    null conv_id is one conversation; an empty table gives no window.
    """
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("text")))
    turns = _numbered(turns)
    repeats = (F.col("sys_tokens") <= budget // 2) & (F.col("sys").isNotNull())
    room = budget - history_tokens - F.when(repeats, F.col("sys_tokens")).otherwise(0)
    step = F.greatest(F.floor(room / 2), F.lit(1))
    turns = turns.withColumns({
        "repeats": F.coalesce(repeats, F.lit(False)),
        "window": 2 * F.floor(F.col("before") / step) + F.when(F.col("tokens") > step, 1).otherwise(0),
    })
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    turns = turns.select(
        "conv_id", "window", "idx", "before", "tokens", "sys", "repeats", "role",
        head.alias("head"), body.alias("body"))

    begun = turns.groupBy("conv_id", "window").agg(
        F.min("idx").alias("first"), F.min("before").alias("before"),
        F.first("sys").alias("sys"), F.first("repeats").alias("repeats"))
    wanted = begun.withColumn("at", F.explode(F.array_distinct(F.concat(
        F.array(F.when(F.col("repeats") & (F.col("sys") < F.col("first")), F.col("sys"))),
        *[F.array(F.col("first") - n) for n in range(1, history_turns + 1)]))))
    wanted = wanted.filter(F.col("at") >= 1).select(
        F.col("conv_id").alias("_conv"), F.col("window").alias("_window"), F.col("at"),
        F.col("before").alias("_start"), "first")
    repeated = (
        turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("idx") == F.col("at")))
        .filter((F.col("repeats") & (F.col("idx") == F.col("sys"))) | (
            (F.col("first") - F.col("idx") <= history_turns)
            & (F.col("_start") - F.col("before") <= history_tokens)))
        .select("conv_id", F.col("_window").alias("window"), "idx", "tokens", "head", "body",
                F.lit(True).alias("old"), F.lit(False).alias("target"))
    )
    rows = turns.select(
        "conv_id", "window", "idx", "tokens", "head", "body",
        F.lit(False).alias("old"), (F.col("role") == "assistant").alias("target"),
    ).unionByName(repeated)
    piece = F.concat("head", "body", F.lit(END))
    upto = Window.partitionBy("conv_id", "window").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("piece", piece).withColumn(
        "at", F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("at").cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))
    return rows.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.sum("tokens").alias("n_tokens"),
        F.min(F.when(~F.col("old"), F.col("idx"))).alias("first_turn"),
        F.count_if("old").cast("int").alias("n_repeated"),
        F.count_if(~F.col("old")).cast("int").alias("n_new"),
        F.sort_array(F.collect_list(F.when(F.col("target"), span))).alias("loss"),
    )


def parsed(formatted: Column) -> Column:
    """Role and text of each turn of a formatted window, repeated ones included."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        size = F.length(piece) - F.length(role) - 1 - len(END)
        return F.struct(
            F.url_decode(role).alias("role"),
            unescaped(F.substring(piece, F.length(role) + 2, size)).alias("text"))

    pieces = F.split(formatted, r"(?<!\\)<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.size(pieces)), turn)


def targets(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))


#: The digests of op9 in plain SQL, with the windows' lengths by their definition.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         ceil(strlen(coalesce(text, '')) / 4)::BIGINT + 6 AS tokens
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
  SELECT *, row_number() OVER w AS idx, (sum(tokens) OVER w)::BIGINT - tokens AS before,
         25 + length(url_encode(role)) + length(regexp_replace(text,
           '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>)', '\\\1\2', 'g')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING)),
systems AS (
  SELECT conv_id AS c, min(idx) AS sys, arg_min(tokens, idx) AS sys_tokens FROM placed WHERE role = 'system' GROUP BY 1),
known AS (
  SELECT p.*, CASE WHEN sys_tokens <= 512 THEN sys END AS sys,
         greatest((1024 - 256 - CASE WHEN sys_tokens <= 512 THEN sys_tokens ELSE 0 END) // 2, 1) AS step
  FROM placed p LEFT JOIN systems s ON p.conv_id IS NOT DISTINCT FROM s.c),
windowed AS (SELECT *, 2 * (before // step) + CASE WHEN tokens > step THEN 1 ELSE 0 END AS win FROM known),
begun AS (SELECT conv_id, win, min(idx) AS first, min(before) AS start, any_value(sys) AS sys FROM windowed GROUP BY ALL),
again AS (
  SELECT b.conv_id, sum(t.chars) AS chars
  FROM begun b JOIN windowed t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.idx < b.first
   AND (t.idx = b.sys OR (b.first - t.idx <= 2 AND b.start - t.before <= 256))
  GROUP BY 1),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx) AS said,
         coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '') AS learned, sum(chars) AS chars
  FROM windowed GROUP BY 1)
SELECT w.conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       (w.chars + coalesce(a.chars, 0))::BIGINT AS formatted_chars
FROM whole w LEFT JOIN again a ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""
