"""Mixing sources to target weights by apportioned, equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.shared import WORD, hash60, stored

REPEATS = 3
#: A block in every shard of a source holds at most this part of the source.
PARTIAL = 200


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``weight`` and ``target`` of each source.

    ``sizes``: source, source_size; a handful of rows. Sources by code point,
    null last, weigh 1, 2, 3, 1, ...; together they get as many words as there
    are. A source stops at ``repeats`` times its size, and what it leaves goes to
    the others by weight. The sources that stop are those with the smallest size
    per weight, so one ordered pass finds the common level of all others.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", 1 + (F.row_number().over(named) - 1) % 3)
    df = df.withColumn("_cap", repeats * F.col("source_size"))
    rising = [F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*rising).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*rising).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent, weighed = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_cap", "weight"))
    level = (F.sum("source_size").over(everything) - spent) / (F.sum("weight").over(everything) - weighed)
    df = df.withColumn("_level", F.when(F.col("_cap") >= level * F.col("weight"), level))
    common = F.first("_level", ignorenulls=True).over(everything)
    target = F.when(F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(F.col("weight") * common)
    return df.withColumn("target", target).drop("_cap", "_level")


def apportioned(df: DataFrame, groups: list[str], claim: str, seats: str, cap: str, tie: list[str], out: str) -> DataFrame:
    """Whole ``seats`` of each group dealt to its rows by Sainte-Laguë.

    A row's quotients are claim / (2k + 1) for its k-th seat, k below ``cap``; the
    highest quotients of a group win, ties to the smaller ``tie``. Seats that
    are certain at any divisor near the ideal one are given at once, and only
    the few at the edge are ranked, so the work grows with rows, not seats. A cap
    stops a row whose share was rounded up; it must not be below the share, or
    seats stay empty.
    """
    group = Window.partitionBy(*groups)
    share = F.col(seats) * F.col(claim) / F.when(F.sum(claim).over(group) > 0, F.sum(claim).over(group))
    slack = 1.5 * F.count(F.lit(1)).over(group) / F.greatest(F.col(seats), F.lit(1))
    df = df.withColumns({"_share": F.coalesce(share, F.lit(0.0)), "_slack": slack})
    low = F.greatest(F.floor(F.col("_share") * (1 - F.col("_slack")) - 0.5) - 1, F.lit(0))
    high = F.floor(F.col("_share") * (1 + F.col("_slack")) + 0.5) + 2
    df = df.withColumns({"_low": F.least(low, F.col(cap)), "_high": F.least(high, F.col(cap))})
    df = df.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    edge = df.filter((F.col("_high") > F.col("_low")) & (F.col(claim) > 0)).withColumn(
        "_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    ranked = Window.partitionBy(*groups).orderBy(
        (F.col(claim) / (2 * F.col("_k") + 1)).desc(), *[F.col(t).asc_nulls_last() for t in tie], "_k")
    won = (
        edge.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*[F.col(c).alias(f"_{c}_key") for c in dict.fromkeys(groups + tie)])
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_key")) for c in dict.fromkeys(groups + tie)]
    return df.join(won, same, "left").withColumn(
        out, F.col("_low") + F.coalesce("_won", F.lit(0))
    ).drop("_share", "_slack", "_low", "_high", "_open", "_won", *[f"_{c}_key" for c in dict.fromkeys(groups + tie)])


def mixed(
    docs: DataFrame,
    keep: list[str] | None = None,
    seed: int = 17,
    repeats: int = REPEATS,
    block_words: int | None = None,
    shards: int | None = None,
) -> DataFrame:
    """doc_id, source and the columns to ``keep``, with size, source_size, target, taken.

    ``docs`` needs doc_id, text and source. Each source's documents are laid out in
    seeded order in ``shards`` stretches and cut into blocks of ``block_words``
    words at most. Sainte-Laguë deals all words to sources by target, then each
    source's blocks to its shards by their number, both as whole numbers; inside a
    shard evenly spaced blocks from a seeded start are taken. A quota above the
    blocks there takes blocks again, at most ``repeats`` times each. ``taken`` is
    the number of a document's words in those blocks.

    A source has one partly filled block in each of its shards. Its blocks are so
    small that a block in every shard is a 200th of its size and of its target, down
    to one word, and it takes as many as hold its words by its own mean block, so
    what partial blocks lack comes from further ones.

    Blocks are at most a millionth of all words, 1 to 1,024, and shards have some 50,000
    documents, unless given; there are 256 at least, so that one large source is
    spread. A null text has size 0, a null source is one source, equal rows are
    separate documents, and an empty table gives an empty result. Kept columns
    must not be named like results. Only md5 decides order and start, so reruns
    agree.
    """
    sized = stored(docs.select(
        "doc_id", "source", *(keep or []),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        hash60(F.col("doc_id"), seed).alias("_place"),
    ))
    rows, words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block_words or max(1, min(1024, words >> 20))
    shards = shards or max(256, -(-rows // 50_000))
    sized = sized.withColumn("_shard", F.col("_place") % shards)
    size = F.col("size")

    parts = sized.groupBy("source", "_shard").agg(F.sum(size).alias("_part"))
    sources = parts.groupBy("source").agg(F.sum("_part").alias("source_size"), F.count(F.lit(1)).alias("_parts"))
    quotas = apportioned(
        targets(sources, repeats).withColumns(
            {"_all": F.lit(0), "_seats": F.lit(words), "_most": repeats * F.col("source_size")}),
        ["_all"], "target", "_seats", "_most", ["source"], "_words",
    )
    fine = F.floor(F.least("source_size", "target") / (PARTIAL * F.col("_parts")))
    quotas = quotas.select(
        F.col("source").alias("_name"), "source_size", "target", "_words",
        F.greatest(F.least(fine, F.lit(block)), F.lit(1)).cast("bigint").alias("_block"))
    parts = parts.join(quotas, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    parts = parts.withColumn("_blocks", F.ceil(F.col("_part") / F.col("_block")))
    held = F.try_divide("source_size", F.sum("_blocks").over(Window.partitionBy("source")))
    parts = parts.withColumns({
        "_quota": F.when(held > 0, F.floor(F.col("_words") / held + 0.5)).otherwise(0).cast("bigint"),
        "_most": repeats * F.col("_blocks"),
    })
    parts = apportioned(
        parts, ["source"], "_blocks", "_quota", "_most", ["_shard"], "_take",
    ).withColumn("_start", hash60("start", F.col("source"), F.col("_shard"), seed) % F.greatest(F.col("_blocks"), F.lit(1)))

    line = Window.partitionBy("source", "_shard").orderBy("_place", "doc_id", "size")
    placed = sized.withColumn("_end", F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.select(
        F.col("source").alias("_name"), F.col("_shard").alias("_at"),
        "source_size", "target", "_block", "_blocks", "_take", "_start")
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("_name")) & (F.col("_shard") == F.col("_at")))

    def taken_before(place: Column) -> Column:
        """Words taken among the first ``place`` words of a shard."""
        div = lambda a, b: F.call_function("div", a, b)
        blocks = lambda n: div(n * F.col("_take") + F.col("_start"), F.col("_blocks"))
        full, block = div(place, F.col("_block")), F.col("_block")
        return blocks(full) * block + (place - full * block) * (blocks(full + 1) - blocks(full))

    taken = F.when(size > 0, taken_before(F.col("_end")) - taken_before(F.col("_end") - size)).otherwise(0)
    return placed.select(
        "doc_id", "source", *(keep or []), "size", "source_size", "target", taken.cast("bigint").alias("taken"))


#: The same in plain SQL for default parameters, up to 2^21 words, where blocks are of
#: one word: every quotient is listed and ranked. Above, it deals blocks of one size and
#: counts partial ones as full.
MIXED_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|17'), 1, 15))::BIGINT AS place
  FROM documents),
facts AS (
  SELECT greatest(1, least(1024, sum(size)::BIGINT >> 20)) AS block, sum(size)::BIGINT AS words,
         greatest(256, ceil(count(*) / 50000.0)::BIGINT) AS shards
  FROM sized),
lined AS (
  SELECT doc_id, source, size, place % shards AS shard,
         sum(size) OVER (PARTITION BY source, place % shards ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized, facts),
parts AS (
  SELECT source, shard, sum(size)::BIGINT AS part, ceil(sum(size)::BIGINT / any_value(block))::BIGINT AS blocks
  FROM lined, facts GROUP BY ALL),
sources AS (
  SELECT source, sum(part)::BIGINT AS source_size, 3 * sum(blocks)::BIGINT AS most,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM parts GROUP BY source),
levels AS (
  SELECT max(level) AS level FROM (
    SELECT (any_value(t.words) - coalesce(sum(3 * b.source_size) FILTER (3 * b.source_size / b.weight < 3 * a.source_size / a.weight), 0))
           / sum(b.weight) FILTER (3 * b.source_size / b.weight >= 3 * a.source_size / a.weight) AS level
    FROM sources a, sources b, facts t GROUP BY a.source)),
aims AS (SELECT s.*, least(3 * source_size, weight * level)::DOUBLE AS target FROM sources s, levels),
quotas AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS rank
    FROM (SELECT source, target, unnest(range(least(most, ceil(1.2 * target / block)::BIGINT + 40))) AS k FROM aims, facts)), facts
  WHERE rank <= words // block GROUP BY source),
takes AS (
  SELECT source, shard, count(*) AS take FROM (
    SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY part / (2 * k + 1) DESC, shard, k) AS rank
    FROM (SELECT p.source, shard, quota, part, unnest(range(3 * blocks)) AS k
          FROM parts p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source WHERE part > 0))
  WHERE rank <= quota GROUP BY ALL),
ready AS (
  SELECT l.*, a.source_size, a.target, p.blocks, coalesce(t.take, 0) AS take, block,
         ('0x' || substr(md5('start|' || coalesce(l.source, 'null') || '|' || l.shard || '|17'), 1, 15))::BIGINT % greatest(p.blocks, 1) AS start
  FROM lined l, facts
  JOIN parts p ON l.source IS NOT DISTINCT FROM p.source AND l.shard = p.shard
  JOIN aims a ON l.source IS NOT DISTINCT FROM a.source
  LEFT JOIN takes t ON l.source IS NOT DISTINCT FROM t.source AND l.shard = t.shard),
ends AS (
  SELECT *, upto // block AS b1, upto % block AS r1, (upto - size) // block AS b0, (upto - size) % block AS r0
  FROM ready WHERE size > 0)
SELECT doc_id, size, source_size, target,
       (((b1 * take + start) // blocks - (b0 * take + start) // blocks) * block
        + r1 * (((b1 + 1) * take + start) // blocks - (b1 * take + start) // blocks)
        - r0 * (((b0 + 1) * take + start) // blocks - (b0 * take + start) // blocks))::BIGINT AS taken
FROM ends
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM ready WHERE size = 0
"""
