"""Line dedup: three consecutive lines that occurred before are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.shared import stored

#: A line ends at a line break or a sentence end, with the blanks after it; blanks
#: and ends before the first line are a piece of their own.
PIECE = r"[.!?\s]+|[^.!?\n]+[.!?\s]*"
ENDS = ".!?"
BLANK = " \t\n\r\x0b\f"
LAST = (1 << 63) - 1


def _hashes(text: Column) -> Column:
    """Hashes of the lines that hold anything, without their ends and outer blanks."""
    plain = F.coalesce(text, F.lit(""))
    for end in ENDS:
        plain = F.replace(plain, F.lit(end), F.lit("\n"))
    told = F.transform(F.split(plain, "\n"), lambda line: F.xxhash64(F.btrim(line, F.lit(BLANK))))
    return F.filter(told, lambda h: h != F.xxhash64(F.lit("")))


def _windows(hashes: Column) -> Column:
    """Hash and place of each three consecutive lines; whether the document had it before."""
    ahead = lambda n: F.slice(hashes, n + 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
    made = F.array_sort(F.transform(
        F.arrays_zip(ahead(0).alias("a"), ahead(1).alias("b"), ahead(2).alias("c")),
        lambda x, at: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("window"), at.alias("place"))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), made["window"])
    return F.transform(
        F.arrays_zip(made.alias("own"), F.slice(before, 1, F.size(made)).alias("last")),
        lambda x: F.struct(
            x["own"]["window"].alias("window"), x["own"]["place"].alias("place"),
            x["own"]["window"].eqNullSafe(x["last"]).alias("again")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; adds n_lines, n_removed.

    A passage is any three consecutive lines. Its first occurrence by doc_id (null
    last), then by place, stays; the lines of every later one go, overlapping ones
    together, also inside one document. Lines hold more than blanks and are compared
    without the blanks and sentence ends around them, as 64-bit hashes; a line goes
    with the ends and blanks that follow it.

    Null and empty texts have no lines; a null text stays null. Rows that share a
    doc_id are versions of one document: none loses a passage to another, and equal
    ones get equal results. Columns named n_lines or n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    docs = docs.select(*rest, "text").withColumn("_tag", F.hash("text"))
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    told = stored(
        docs.select(order.alias("_doc"), "_tag", _hashes(F.col("text")).alias("_hashes"))
        .select("_doc", "_tag", F.size("_hashes").alias("_lines"), _windows(F.col("_hashes")).alias("_windows")))
    found = told.select("_doc", "_tag", F.inline("_windows"))
    once = found.filter("NOT again")
    known = (
        once.groupBy(F.col("window").alias("_window"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("_from"))
        .filter("_n > 1")
    )
    later = once.join(known, F.col("window") == F.col("_window")).filter("_doc > _from")
    nothing = F.lit(None).cast("int")
    of_doc = (
        told.select("_doc", "_tag", "_lines", nothing.alias("place"))
        .unionByName(later.select("_doc", "_tag", nothing.alias("_lines"), "place"))
        .unionByName(found.filter("again").select("_doc", "_tag", nothing.alias("_lines"), "place"))
        .groupBy("_doc", F.col("_tag").alias("_of"))
        .agg(F.max("_lines").alias("n_lines"), F.collect_set("place").alias("_places"))
        .withColumn("_gone", F.array_distinct(F.flatten(F.transform("_places", lambda at: F.array(at, at + 1, at + 2)))))
    )
    return docs.join(of_doc, (order == F.col("_doc")) & (F.col("_tag") == F.col("_of"))).select(
        *rest,
        F.when(F.size("_gone") == 0, F.col("text")).otherwise(_without(F.col("text"), F.col("_gone"))).alias("text"),
        "n_lines", F.size("_gone").alias("n_removed"),
    )


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines of the numbers ``gone``."""
    # looked up for every line that goes, so in the first character, not in the text
    lead = F.when(F.substring(text, 1, 1).isin(*(ENDS + BLANK)), 1).otherwise(0)

    def rest(pieces: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.transform(gone, lambda at: at + lead))
        return F.array_join(F.transform(kept, lambda at: F.get(pieces, at)), "")

    # as a lambda's variable the pieces are cut once, not once for each line
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), rest)[0]


#: The same in plain SQL, by the lines themselves.
LINES_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[.!?\s]+|[^.!?\n]+[.!?\s]*') AS pieces
  FROM documents),
lines AS (
  SELECT doc_id, spot, regexp_replace(pieces[spot], '^[.!? \t\n\r\f\v]+|[.!? \t\n\r\f\v]+$', '', 'g') AS line
  FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS spot FROM cut)),
windows AS (
  SELECT doc_id, spot, [line, lead(line) OVER w, lead(line, 2) OVER w] AS passage
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY spot)
  QUALIFY lead(line, 2) OVER w IS NOT NULL),
later AS (
  SELECT doc_id, spot, row_number() OVER (PARTITION BY passage ORDER BY doc_id, spot) AS occurrence
  FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(spot, spot + 3)) AS spot FROM later WHERE occurrence > 1),
spots AS (SELECT doc_id, list(spot) AS spots FROM gone GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM lines WHERE line <> '' GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0)::INT AS n_lines, coalesce(len(spots), 0)::INT AS n_removed,
       CASE WHEN spots IS NULL THEN text
            ELSE array_to_string(list_filter(pieces, lambda x, i: NOT list_contains(spots, i)), '') END AS text
FROM cut c LEFT JOIN spots s ON c.doc_id = s.doc_id LEFT JOIN counts k ON c.doc_id = k.doc_id
"""
