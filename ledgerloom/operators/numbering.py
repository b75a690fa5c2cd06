"""Row numbers and previous-row values that never sort a whole group in one task.

A group (a workbook, a report, one log chain) may hold a large part of all rows.
Both helpers split it into blocks of bounded width, work inside the blocks in
parallel, and carry one small summary row per block across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import cut

BLOCK_WIDTH = 4096
#: Rows of a group that are sorted at once.
HELD = 100_000


def _keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], bool]:
    if keys:
        return df, keys, False
    return df.withColumn("_all", F.lit(0)), ["_all"], True


def numbered(
    df: DataFrame, keys: list[str], coarse: list[Column], fine: list[Column], out: str
) -> DataFrame:
    """1-based number of each row within ``keys``, ordered by ``coarse`` then ``fine``.

    ``coarse`` must split a group into pieces small enough to sort in one task
    (a tab and a stretch of rows, a stretch of ids); the pieces are counted
    first and their running totals added to the numbers inside each piece.
    """
    df, keys, added = _keys(df, keys)
    names = [f"_b{i}" for i in range(len(coarse))]
    columns = df.columns
    # One struct names a piece, nulls equal to nulls, so rows dealt by it for their numbers
    # stay where they are when the totals join them.
    piece = F.struct(*keys, *[c.alias(n) for c, n in zip(coarse, names)])
    df = df.select(piece.alias("_piece"), *[F.col(f"`{c}`") for c in columns if c not in keys])
    pieces = df.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    part = lambda c: F.col("_piece")[c]
    ahead = Window.partitionBy(*map(part, keys)).orderBy(*map(part, names)).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_piece", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    dealt = df.repartition("_piece").withColumns({k: part(k) for k in keys})
    dealt = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_piece").orderBy(*fine)))
    result = dealt.join(pieces, "_piece").select(
        *[F.col(f"`{c}`") for c in columns], (F.col("_before") + F.col("_in")).cast("bigint").alias(out))
    return result.drop("_all") if added else result


def numbered_by_size(
    df: DataFrame, keys: list[str], coarse: list[Column], fine: list[Column], out: str
) -> DataFrame:
    """``numbered`` where most groups are small: groups are counted, and those that can be sorted
    at once are dealt once. Only the larger ones are split into pieces."""
    name = F.struct(*keys)
    large = cut(df.groupBy(name.alias("_group")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HELD).select("_group"))
    of_large = name == F.col("_group")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*coarse, *fine)).cast("bigint").alias(out)
    small = df.join(F.broadcast(large), of_large, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns], place)
    if large.isEmpty():
        return small
    return small.unionByName(numbered(df.join(F.broadcast(large), of_large, "left_semi"), keys, coarse, fine, out))


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    first: Column,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Value of the preceding surviving row in ``order`` (an integer, unique per key).

    The first row of a block takes its predecessor from a table with one row per
    block; the very first row of a chain gets ``first``.
    """
    df, keys, added = _keys(df, keys)
    df = df.withColumn("_block", F.floor(F.col(order) / width))
    tails = df.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_tail"))
    # One more level, so that even a single chain leaves few rows for one sort.
    tails = tails.withColumn("_wide", F.floor(F.col("_block") / width))
    far = (
        tails.groupBy(*keys, "_wide").agg(F.max_by("_tail", "_block").alias("_last"))
        .withColumn("_far", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_wide")))
        .drop("_last")
    )
    near = F.lag("_tail").over(Window.partitionBy(*keys, "_wide").orderBy("_block"))
    tails = tails.join(far, [*keys, "_wide"]).select(
        *keys, "_block", F.coalesce(near, F.col("_far")).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    result = (
        df.join(tails, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.lag(value).over(inside), F.col("_carried"), first))
        .drop("_carried", "_block")
    )
    return result.drop("_all") if added else result
