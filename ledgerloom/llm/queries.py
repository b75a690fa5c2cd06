"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bytelevel, chat, counts, kneser, leaks, lines, merkle, mixing, near, neighbours, repair, toxic, whitening
from ledgerloom.llm.shared import stored, table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mixing"] = mixing.MIXED_SQL


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows.

    A digest is over one conversation's whole text, so one row of text per
    conversation is put together here; the windows themselves never are.
    """
    own = spark.createDataFrame(
        [(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))],
        "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = stored(chat.windows(rows))
    turns = F.slice(chat.parsed(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_new"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(chat.targets(F.col("formatted"), F.col("loss")), "")
    read = made.select(
        "conv_id", F.size(turns).alias("n"), F.length("formatted").alias("chars"),
        F.struct("first_turn", said.alias("said"), learned.alias("learned")).alias("part"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"),
        F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("learned")).cast("bigint").alias("loss_chars"),
        F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")


@query
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occurred before."""
    return lines.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text")


ORACLES["op10_lines"] = lines.LINES_SQL


@query
def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, by 2-word shingles."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count and best score of every document."""
    counted = counts.token_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", counted.alias("c")).select(
        "doc_id", "c.n_tokens", "c.score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and whether its label was kept from training."""
    return toxic.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query
def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("l")).select(
        "doc_id", "l.item_id", "l.score", "l.question", "l.answer")


@query
def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the shards."""
    return repair.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query
def op7_kneser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the bigram model of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", kneser.held_out(F.col("doc_id")))
    return kneser.scored(docs, kneser.train(docs.filter("NOT held_out"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
ORACLES["op9_chat"] = chat.CHAT_SQL


@query
def op12_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, and its bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bytelevel.encoded(table(spark, sf_dir, "documents"), ranks, keep=["doc_id"])
    return made.select(
        "row.doc_id", (F.octet_length("coded.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(bytelevel.decoded(F.col("coded"), ranks), 256).alias("decoded_sha256"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document against the root, a third of them with a lowered text."""
    lowered = merkle.leaf_of(merkle.small_letters(F.col("text")))
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered)
    made = merkle.manifest(table(spark, sf_dir, "documents"), claim)
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.col("claim"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


ORACLES["op13_manifest"] = merkle.MANIFEST_SQL


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the four leading components of the distinct ones."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return made.select(
        "row.vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        "explained", "identity_error")
