"""Documents to training shards: filter, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import leaks, mixing, near, repair, toxic
from ledgerloom.llm.shared import hash60, stored, table


#: Columns that the operators read. The others travel in a struct, where no name can clash.
READ = ("doc_id", "text", "source")


def _held(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(F.lit(0).alias("_"), *others).alias("_row"))


def _freed(held: DataFrame, columns: list[str]) -> DataFrame:
    """The rows' own columns again, in their order."""
    return held.select(*[F.col(c) if c in READ else F.col(f"_row.`{c}`") for c in columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; without labels all stay.

    Null and empty texts have a low score and stay; repeated rows share their fate.
    """
    scored = toxic.scored(_held(docs), table(spark, sf_dir, "labels"))
    return _freed(scored.filter("predicted = 0"), docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group.

    Of rows that share a doc_id one stays, the same in every run: the first by digest
    of its text and then of all columns. Rows without doc_id all stay, and texts
    without words are copies of nothing.
    """
    kept = near.near_duplicates(docs.select("doc_id", "text"), width=5).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = _held(docs).join(kept, "doc_id", "left_semi")
    order = F.struct(F.sha2("text", 256), "source", F.xxhash64(F.to_json("_row")))
    one = held.groupBy("doc_id").agg(F.min_by(F.struct("text", "source", "_row"), order).alias("one"))
    named = _freed(one.select("doc_id", "one.*"), docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    found = leaks.with_leaks(_held(docs), table(spark, sf_dir, "benchmark"))
    return _freed(found.filter(F.size("leaks") == 0), docs.columns)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, on average.

    A fraction of a copy becomes a whole one with that chance, by a hash of the row,
    so a source's written words come near its target and no document is written
    more than the mix's repeats. Texts without words are not taken.
    """
    mixed = mixing.mixed(_held(docs), keep=["text", "_row"])
    chance = hash60(F.lit("copies"), F.col("doc_id"), F.xxhash64("text")) / F.lit(float(1 << 60))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(0)
    copied = mixed.withColumn("_copies", F.least(copies, F.lit(mixing.REPEATS)).cast("int")).filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return _freed(copied, docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the shards."""
    return repair.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_copies),
    ("decontamination", without_leaks),
    ("mixing", in_proportion),
    ("tokens", as_tokens),
]

#: A trained model and a tokenizer decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
