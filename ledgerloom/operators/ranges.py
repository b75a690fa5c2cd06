"""Ranges of cells as row intervals and aligned row blocks, whatever their size.

A rectangle is never listed cell by cell to be counted, summed or joined. It splits
into columns, a column into blocks of 1, 64, 4096 and 262144 rows: whole blocks in
the middle, smaller ones at both edges, some hundreds at most. A cell lies in one
block of each width, so rectangles and cells meet by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import cut

#: Rows of a block of each level.
WIDTHS = [64**level for level in range(4)]
#: Intervals are merged in stretches of that many rows.
STRETCH = 4096


def blocks(first: Column, last: Column) -> Column:
    """The aligned blocks (level, block) that make up rows ``first``..``last``, in order of rows."""
    begin, end = [first.cast("bigint")], [last.cast("bigint") + 1]
    for _ in WIDTHS[1:]:
        begin.append(F.floor((begin[-1] + 63) / 64))
        end.append(F.floor(end[-1] / 64))

    def run(level: int, a: Column, b: Column) -> Column:
        """Blocks a..b-1 of a level; none if a is not below b."""
        made = F.transform(F.sequence(a, b - 1), lambda n: F.struct(
            (n * WIDTHS[level]).alias("row"), F.lit(level).alias("level"), n.alias("block")))
        return F.when(a < b, made).otherwise(F.array().cast("array<struct<row: bigint, level: int, block: bigint>>"))

    made = run(3, begin[3], end[3])
    for level in (2, 1, 0):
        a, b, x, y = begin[level], end[level], begin[level + 1], end[level + 1]
        edges = F.concat(run(level, a, x * 64), made, run(level, y * 64, b))
        made = F.when(x < y, edges).otherwise(run(level, a, b))
    alone = F.array(F.struct(begin[0].alias("row"), F.lit(0).alias("level"), begin[0].alias("block")))
    return F.when(first == last, alone).otherwise(made)  # most references are single cells


def by_column(rects: DataFrame) -> DataFrame:
    """A row per column of each rectangle: ``col`` in place of c1 and c2."""
    return rects.withColumn("col", F.explode(F.sequence("c1", "c2"))).drop("c1", "c2")


def in_blocks(columns: DataFrame) -> DataFrame:
    """A row per block of each column: ``row`` it starts at, ``level`` and ``block`` for r1 and r2."""
    return columns.select(
        *[c for c in columns.columns if c not in ("r1", "r2")], F.inline(blocks(F.col("r1"), F.col("r2"))))


def meet(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """Every pair of a rectangle and a cell inside it; the cells' columns beside the rectangles'.

    ``rects``: workbook_id, dst_tab, c1, c2, r1, r2 and others. ``cells``:
    workbook_id, dst_tab, col, row and others. Both sides are joined on equal
    blocks, one rule for every size; empty cells meet nothing.
    """
    pieces = cut(in_blocks(by_column(rects)).drop("row"))
    key = ["workbook_id", "dst_tab", "col"]
    found = pieces.filter("level = 0").drop("level").join(
        cells.withColumn("block", F.col("row").cast("bigint")), [*key, "block"]).drop("block")
    wide = pieces.filter("level > 0")
    if wide.isEmpty():
        return found
    levels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), F.floor(F.col("row") / w).alias("block")) for i, w in enumerate(WIDTHS) if i]))
    inside = cells.join(wide.select("workbook_id", "dst_tab", "col").distinct(), key, "left_semi").withColumn("_at", levels)
    inside = inside.select(*cells.columns, "_at.level", "_at.block")
    return found.unionByName(wide.join(inside, [*key, "level", "block"]).drop("level", "block"))


def merged(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Rows covered by the rectangles of each key: disjoint intervals (dst_tab, col, r1, r2).

    Intervals are cut at fixed stretches of rows and repeats dropped before any two
    meet, so a key with very many rectangles is merged by many tasks. In order of
    their start, what an interval adds begins after the largest end before it.
    Rectangles of single formulas (a key with ``src``) are dealt by formula once, as
    its length bounds how many there are.
    """
    rects = rects.select(*keys, "dst_tab", "c1", "c2", "r1", "r2")
    if "src" in keys:
        rects = rects.repartition(*keys)
    columns = by_column(rects.distinct())
    stretch = F.explode(F.sequence(F.floor(F.col("r1") / STRETCH), F.floor(F.col("r2") / STRETCH)))
    pieces = columns.withColumn("_stretch", stretch).select(
        *keys, "dst_tab", "col", "_stretch",
        F.greatest(F.col("r1"), F.col("_stretch") * STRETCH).alias("r1"),
        F.least(F.col("r2"), (F.col("_stretch") + 1) * STRETCH - 1).alias("r2"),
    ).groupBy(*keys, "dst_tab", "col", "_stretch", "r1").agg(F.max("r2").alias("r2"))
    ahead = Window.partitionBy(*keys, "dst_tab", "col", "_stretch").orderBy("r1").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("_upto", F.max("r2").over(ahead)).withColumn(
        "r1", F.greatest(F.col("r1"), F.coalesce(F.col("_upto") + 1, F.col("r1")))).filter("r1 <= r2").drop("_upto", "_stretch")


def gaps(covered: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the merged intervals that hold no cell, as intervals again.

    ``covered`` comes from ``merged``; ``cells``: workbook_id, dst_tab, col, row, one
    row per cell. A cell ends a gap before it and begins one after it.
    """
    whole = covered.withColumns({"c1": F.col("col"), "c2": F.col("col")}).drop("col").withColumn("_from", F.col("r1"))
    held = meet(whole, cells.select("workbook_id", "dst_tab", "col", "row")).select(*keys, "dst_tab", "col", "_from", "row")
    # Marks beside each interval: a row before its start, its cells, a row after its end.
    spot = [*keys, "dst_tab", "col", "_from"]
    marks = covered.withColumn("_from", F.col("r1")).select(
        *spot, F.explode(F.array((F.col("r1") - 1).cast("bigint"), (F.col("r2") + 1).cast("bigint"))).alias("row")
    ).unionByName(held.withColumn("row", F.col("row").cast("bigint")))
    before = F.lag("row").over(Window.partitionBy(*spot).orderBy("row"))
    return marks.withColumn("_before", before).filter(F.col("row") - F.col("_before") > 1).select(
        *keys, "dst_tab", "col", (F.col("_before") + 1).alias("r1"), (F.col("row") - 1).alias("r2"))
