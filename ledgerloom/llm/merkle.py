"""Merkle manifest of a dataset: leaf, root, proof and check of every document.

A document's place among its language's leaves is a rank query: every task's bitmap
of doc_ids is merged by or into words of 64 ids, only words with an id are kept, and
a directory of counts says how many rows lie before each word. No leaf is sorted.
Places then key slot arrays of eight, level by level, up to one root, and the
siblings are handed down the same levels, so that no task sees a whole tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.shared import stored
from ledgerloom.operators.numbering import numbered

#: Children of a node. Fixed value of the manifest.
FAN = 8
#: Ids of one bitmap word, and words (or blocks of words) of one directory block, as powers of two.
WORD_BITS, BLOCK_BITS = 6, 9
#: The word of rows without a doc_id, before all others.
NO_ID = -(1 << 58)
#: Leaves of one doc_id are spread by so many hex digits; copies of one row by so many.
TIE_DIGITS, COPIES = 4, 4096

PATH = "array<struct<left: string, right: string>>"


def _field(value: Column) -> Column:
    """A value with its byte count before it, or the mark of a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """Leaf digest of a document row, with another text than its own where one is given."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def small_letters(text: Column) -> Column:
    """A-Z lowered, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _directory(words: DataFrame, top: int, shift: int = 0) -> DataFrame:
    """``before``: rows of the tree in smaller words, from blocks of 512 words and blocks of those."""
    if shift >= top:
        order = Window.partitionBy("tree").orderBy("word")
        return words.withColumn("before", F.sum("rows").over(order) - F.col("rows"))
    words = words.withColumn("_block", F.shiftright("word", BLOCK_BITS))
    blocks = words.groupBy("tree", F.col("_block").alias("word")).agg(F.sum("rows").alias("rows"))
    blocks = _directory(blocks, top, shift + BLOCK_BITS).select("tree", F.col("word").alias("_block"), F.col("before").alias("_ahead"))
    inside = Window.partitionBy("tree", "_block").orderBy("word")
    return words.withColumn("_upto", F.sum("rows").over(inside)).join(blocks, ["tree", "_block"]).withColumn(
        "before", F.col("_ahead") + F.col("_upto") - F.col("rows")).drop("_block", "_upto", "_ahead")


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """A row per leaf with its ``idx`` (from 0) in its tree, and the leaves of the largest tree.

    ``leaves``: tree, doc_id, leaf, claim, copies. Leaves of one doc_id follow their
    digests; equal rows follow each other.
    """
    leaves = leaves.withColumns({
        "word": F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(NO_ID)),
        "bit": F.coalesce(F.col("doc_id").bitwiseAND((1 << WORD_BITS) - 1), F.lit(0)).cast("int")})
    ids = leaves.groupBy("tree", "word", "bit").agg(F.sum("copies").alias("n"))
    words = stored(ids.groupBy("tree", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("rows"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))).alias("extra")))
    known = words.groupBy("tree").agg(
        F.min("word").alias("low"), F.max("word").alias("high"), F.sum("rows").alias("rows"),
        F.max(F.size("extra")).alias("extra"))
    low, high, most, extra = known.agg(F.min("low"), F.max("high"), F.max("rows"), F.max("extra")).first()
    if most is None:
        return leaves.withColumn("idx", F.lit(0).cast("bigint")).drop("copies", "word", "bit"), 0
    top = 0
    while (high >> top) - (low >> top) >= 1 << BLOCK_BITS:
        top += BLOCK_BITS
    ranks = _directory(words, top).drop("rows")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    more = F.aggregate(F.filter("extra", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("bigint"), lambda n, x: n + x["more"])
    placed = leaves.join(ranks, ["tree", "word"]).withColumns({
        "idx": F.col("before") + below + more,
        "_again": F.exists("extra", lambda x: x["bit"] == F.col("bit"))}).drop("bits", "before", "extra")
    columns = ["tree", "doc_id", "leaf", "claim", "idx"]
    if not extra:
        return placed.select(*columns), most
    again = placed.filter("_again").withColumn("_piece", F.substring("leaf", 1, TIE_DIGITS))
    one = ["tree", "word", "bit"]
    pieces = again.groupBy(*one, "_piece").agg(F.sum("copies").alias("_n"))
    pieces = pieces.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(*one).orderBy("_piece")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*one, "_piece").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("_upto", F.sum("copies").over(inside) - F.col("copies")).join(pieces, [*one, "_piece"]).withColumn(
        "idx", F.col("idx") + F.col("_ahead") + F.col("_upto"))
    # A row that stands for many copies is dealt out in stretches before each copy gets its place.
    again = again.withColumn("_part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition(
        *one, "leaf", "_part").withColumn(
        "idx", F.explode(F.expr(f"sequence(idx + _part * {COPIES}, idx + least((_part + 1) * {COPIES}, copies) - 1)")))
    return placed.filter("NOT _again").select(*columns).unionByName(again.select(*columns)), most


def _height(leaves: int) -> int:
    levels = 1
    while FAN ** levels < leaves:
        levels += 1
    return levels


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Slot arrays of each level: tree, idx, slots, digest; the last has a row per tree.

    ``nodes``: tree, idx, digest and what else the lowest slots carry. A tree that
    is one node already stays that node on the levels above.
    """
    made = []
    for _ in range(height):
        slot = F.struct((F.col("idx") % FAN).alias("slot"), *[c for c in nodes.columns if c not in ("tree", "idx")])
        runs = nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("idx")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        digests = F.transform("slots", lambda s: s["digest"])
        alone = (F.col("idx") == 0) & (F.size("slots") == 1)
        runs = stored(runs.withColumn("digest", F.when(alone, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), 256))))
        made.append(runs)
        nodes = runs.select("tree", "idx", "digest")
    return made


def _handed_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """What each lowest slot carries, beside the columns of its tree's top and its whole path.

    ``tops``: tree, path above the tree, and other columns of a tree.
    """
    above = tops.withColumn("idx", F.lit(0).cast("bigint"))
    others = [c for c in tops.columns if c not in ("tree", "path")]
    for runs in reversed(levels):
        both = runs.select("tree", "idx", "slots").join(above, ["tree", "idx"])
        digests = F.transform("slots", lambda s: s["digest"])
        both = both.select(
            "tree", "idx", "path", *others, digests.alias("_digests"), F.posexplode("slots").alias("_at", "_slot"))
        step = F.struct(
            F.array_join(F.slice("_digests", 1, F.col("_at")), "").alias("left"),
            F.array_join(F.slice("_digests", F.col("_at") + 2, FAN), "").alias("right"))
        alone = (F.col("idx") == 0) & (F.size("_digests") == 1)
        above = both.select(
            "tree", (F.col("idx") * FAN + F.col("_at")).alias("idx"), *others, "_slot",
            F.when(alone, F.col("path")).otherwise(F.concat(F.array(step), "path")).alias("path"))
        if runs is not levels[0]:
            above = above.drop("_slot")
    return above.drop("idx").select("tree", "path", *others, "_slot.*").drop("slot")


def manifest(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, claim, subroot, root and path of every row of documents.

    ``path`` lists, from the leaf to the root, the digests ``left`` and ``right`` of
    the node's siblings, joined; levels without siblings are not in it. ``claim`` is
    a leaf to be checked against the root, computed from the columns of ``docs``;
    null is the row's own leaf. Needs doc_id, source, lang, n_chars and text; other
    columns are not carried, so none can clash.

    Nulls are fields of their own: a null lang is the first language, null doc_ids
    are the first leaves of theirs. Rows that share a doc_id follow their leaf
    digests, and equal rows are leaves of their own. Empty and very long texts are
    texts like others. An empty table gives no row.

    Documents are hashed where they are read; from there on only digests move.
    A hot language is spread by place, a hot doc_id by digest, copies by count. A
    row per language meets in few tasks, by the first letters of its name.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_of().alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    placed, most = _placed(rows)
    levels = _levels(placed.select("tree", "idx", F.col("leaf").alias("digest"), "doc_id", "claim"), _height(most))
    subroots = levels[-1].select("tree", "digest")
    order = numbered(subroots, [], [F.substring("tree", 1, 3)], [F.col("tree")], "no")
    tops = stored(order.select(F.lit("").alias("tree"), (F.col("no") - 1).alias("idx"), "digest", F.col("tree").alias("lang")))
    top_levels = _levels(tops, _height(tops.count()))
    root = top_levels[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    trees = _handed_down(top_levels, root).select(
        F.col("lang").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = _handed_down(levels, trees)
    return found.select(
        "doc_id", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang"), F.col("digest").alias("leaf"),
        F.coalesce("claim", "digest").alias("claim"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """Digest of a path's siblings, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


#: Leaves, both trees, walks up for proof and check, by recursion in plain SQL.
MANIFEST_SQL = """
WITH RECURSIVE rows AS (
  SELECT *, doc_id::VARCHAR AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
coded AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, text, lowered,
         concat_ws('', coalesce(strlen(d) || ':' || d, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         list_reduce(list_prepend(4294967295::BIGINT, range(8 * strlen(d))), lambda c, i: xor(
           xor(c, CASE WHEN i % 8 = 0 THEN ascii(d[i // 8 + 1]) ELSE 0 END)::BIGINT // 2,
           CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(d[i // 8 + 1]) ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM rows),
hashed AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS claim
  FROM coded),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS id
  FROM hashed),
nodes AS (
  SELECT 0 AS level, tree, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY level, tree, idx // 8, n),
runs AS (SELECT level, tree, idx // 8 AS run, n, list(digest ORDER BY idx) AS digests FROM nodes GROUP BY ALL),
walk AS (
  SELECT id, tree, 0 AS level, idx, n, coalesce(claim, leaf) AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT id, w.tree, w.level + 1, w.idx // 8, (w.n + 7) // 8,
         sha256(array_to_string(digests[1:w.idx % 8], '') || node || array_to_string(digests[w.idx % 8 + 2:8], '')),
         proof || array_to_string(digests[1:w.idx % 8], '') || array_to_string(digests[w.idx % 8 + 2:8], '')
  FROM walk w JOIN runs r ON w.level = r.level AND w.tree = r.tree AND w.idx // 8 = r.run WHERE w.n > 1),
tops AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
high AS (
  SELECT 0 AS level, idx, n, digest FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1
  GROUP BY level, idx // 8, n),
high_runs AS (SELECT level, idx // 8 AS run, list(digest ORDER BY idx) AS digests FROM high GROUP BY ALL),
climb AS (
  SELECT w.id, 0 AS level, t.idx, t.n, node, proof, digest AS subroot FROM walk w JOIN tops t ON w.tree = t.tree WHERE w.n = 1
  UNION ALL
  SELECT id, c.level + 1, c.idx // 8, (n + 7) // 8,
         sha256(array_to_string(digests[1:c.idx % 8], '') || node || array_to_string(digests[c.idx % 8 + 2:8], '')),
         proof || array_to_string(digests[1:c.idx % 8], '') || array_to_string(digests[c.idx % 8 + 2:8], ''), subroot
  FROM climb c JOIN high_runs r ON c.level = r.level AND c.idx // 8 = r.run WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climb JOIN leaves USING (id), (SELECT digest AS root FROM high WHERE n = 1) WHERE climb.n = 1
"""
