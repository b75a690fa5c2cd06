"""Interpolated modified Kneser-Ney bigrams: counted in Spark, mapped from files by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.shared import shared_folder
from ledgerloom.llm.words import WordHashes, chained, hashed, texts_of, words

#: Hashes of what stands before a text and ends it; no word has a blank in it.
START, END = (np.uint64(WordHashes()[x]) for x in (b" start", b" end"))
#: Text bytes of a shard; tokens counted or scored at once.
SHARD_BYTES, TOKENS = 1 << 24, 1 << 20
ESCAPE = 255


# -- files -------------------------------------------------------------------


def put(folder: str, name: str, values: np.ndarray) -> None:
    """One array as one file, whole or not at all, however often a task is run again."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(values).data.cast("B") if len(values) else b"")
    fs.move(own, f"{path}/{name}")


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of ``put`` mapped into memory; a remote one is fetched and unlinked first."""
    fs, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}")
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with tempfile.NamedTemporaryFile() as own, fs.open_input_stream(path) as source:
        while part := source.read(1 << 24):
            own.write(part)
        own.flush()
        return np.memmap(own.name, kind, "r") if own.tell() else np.empty(0, kind)


# -- counting ----------------------------------------------------------------


def _packed(left: np.ndarray, right: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Arrays of equal length; ``left`` rises, so its steps are mostly nothing."""
    small = np.concatenate([np.diff(left, prepend=np.uint64(0)), *[n.astype(np.uint64) for n in numbers]])
    squeezed = zstandard.ZstdCompressor(level=1).compress(small.tobytes())
    return len(left).to_bytes(8, "little") + right.astype(np.uint64).tobytes() + squeezed


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    right = np.frombuffer(blob, np.uint64, n, 8)
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + 8 * n:]), np.uint64).reshape(-1, n)
    return [np.cumsum(small[0], dtype=np.uint64), right, *small[1:]]


def _joined(blobs) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpacked(bytes(b)) for b in blobs))]


def tokens_of(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of a text's words and of its end."""
    return np.append(hashed(words(text), known), END)


def _before(flat: np.ndarray) -> np.ndarray:
    """What stands before each token."""
    made = np.r_[START, flat[:-1]]
    made[made == END] = START
    return made


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order of ``keys``, where each distinct one begins, and the numbers added up."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])[: len(keys)]
    return order, begins, [np.add.reduceat(n[order], begins) if len(keys) else n for n in numbers]


def _counted(docs: DataFrame, shards: int) -> DataFrame:
    """Pairs of tokens and their counts, packed by the shard of the first."""
    def work(batches):
        known = WordHashes()

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            right = np.concatenate(held)
            left = _before(right)
            order, begins, (n,) = _summed(chained(left, right), np.ones(len(right), np.int64))
            left, right = left[order][begins], right[order][begins]
            shard = (left % np.uint64(shards)).astype(np.int64)
            by = np.lexsort((left, shard))
            left, right, n, shard = left[by], right[by], n[by], shard[by]
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            blobs = [_packed(left[a:z], right[a:z], n[a:z]) for a, z in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["shard", "pairs"])

        held, size = [], 0
        for (texts,) in texts_of(batches, "text"):
            for text in texts:
                made = tokens_of(text, known)
                held.append(made)
                size += len(made)
                if size >= TOKENS:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select("text").mapInArrow(work, "shard bigint, pairs binary")


STATS = "kind string, n1 bigint, n2 bigint, n3 bigint, n4 bigint, kinds bigint, total bigint"


def _stats(kind: str, counts: np.ndarray, kinds: int, total: int) -> dict:
    seen = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
    return {"kind": kind, **{f"n{k}": int(seen[k]) for k in (1, 2, 3, 4)}, "kinds": kinds, "total": total}


def _write_pairs(folder: str, shards: int):
    """Adds up one shard's pairs, writes its files, and passes on what the second words need."""
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        left, right, n = _joined(rows["pairs"])
        keys = chained(left, right)
        order, begins, (n,) = _summed(keys, n.astype(np.int64))
        keys, left, right = keys[order][begins], left[order][begins], right[order][begins]
        put(folder, f"pairs-{shard}", keys)
        put(folder, f"pair-counts-{shard}", np.where(n < ESCAPE, n, ESCAPE).astype(np.uint8))
        put(folder, f"large-{shard}", keys[n >= ESCAPE])
        put(folder, f"large-counts-{shard}", n[n >= ESCAPE].astype(np.uint64))
        # followers of each first word by how often they follow; a word seen once needs no row
        order, begins, sums = _summed(left, n, n == 1, n == 2, n >= 3)
        several = sums[0] > 1
        put(folder, f"contexts-{shard}", left[order][begins][several])
        put(folder, f"followers-{shard}", np.stack(sums[1:], axis=1)[several].astype(np.uint32))
        of = (right % np.uint64(shards)).astype(np.int64)
        by = np.lexsort((right, of))
        right, m, of = right[by], n[by], of[by]
        cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
        made = []
        for a, z in zip(cuts, cuts[1:]):
            order, begins, (firsts, count) = _summed(right[a:z], np.ones(z - a, np.int64), m[a:z])
            words_ = right[a:z][order][begins]
            made.append({"shard": int(of[a]), "ends": _packed(words_, firsts, count)})
        starts = int(n[left == START].sum())
        made.append({"shard": -1, "ends": None, **_stats("pairs", n, len(n), starts)})
        return pd.DataFrame(made).reindex(columns=["shard", "ends", "kind", "n1", "n2", "n3", "n4", "kinds", "total"]).astype(
            {c: "Int64" for c in ("n1", "n2", "n3", "n4", "kinds", "total")})

    return work


def _write_words(folder: str):
    """Adds up one shard's words and writes its files; pairs' figures pass through."""
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        if int(key[0]) < 0:
            return rows[["kind", "n1", "n2", "n3", "n4", "kinds", "total"]]
        words_, firsts, n = _joined(rows["ends"])
        order, begins, (firsts, n) = _summed(words_, firsts.astype(np.int64), n.astype(np.int64))
        put(folder, f"words-{int(key[0])}", words_[order][begins])
        put(folder, f"firsts-{int(key[0])}", firsts.astype(np.uint32))
        put(folder, f"word-counts-{int(key[0])}", n.astype(np.uint64))
        return pd.DataFrame([_stats("words", firsts, len(n), int(n.sum()))])

    return work


# -- the model ---------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more, from counts of counts.

    Where these are too few to tell, half of it, 1 and 1.5 are.
    """
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    made = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(made, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


@dataclass
class Model:
    """Figures of the whole corpus, and where its sorted arrays are."""

    folder: str
    shards: int
    pairs: np.ndarray
    words: np.ndarray
    kinds: int
    firsts: int
    tokens: int
    texts: int

    def opened(self) -> Reader:
        return Reader(self)


class Reader:
    """A model's arrays, mapped when first looked into."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}

    def _array(self, name: str, shard: int, kind: str) -> np.ndarray:
        if (name, shard) not in self.open:
            try:
                self.open[name, shard] = np.asarray(mapped(self.model.folder, f"{name}-{shard}", kind))
            except FileNotFoundError:  # no such hash in the corpus
                self.open[name, shard] = np.empty(0, kind)
        return self.open[name, shard]

    def find(self, keys: np.ndarray, of: np.ndarray, table: str, *columns: tuple[str, str, int]) -> list[np.ndarray]:
        """Rows of ``columns`` (name, kind, width) at the places of ``keys`` in ``table``, 0 where there is none."""
        out = [np.zeros((len(keys), w), np.float64) for _, _, w in columns]
        shard = (of % np.uint64(self.model.shards)).astype(np.int64)
        order = np.lexsort((keys, shard))
        cuts = np.r_[np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]), len(keys)] if len(keys) else []
        for a, z in zip(cuts, cuts[1:]):
            own, at = order[a:z], int(shard[order[a]])
            sorted_ = self._array(table, at, "<u8")
            place = np.searchsorted(sorted_, keys[own])
            place[place == len(sorted_)] = 0
            hit = sorted_[place] == keys[own] if len(sorted_) else np.zeros(len(own), bool)
            for x, (name, kind, width) in zip(out, columns):
                x[own[hit]] = self._array(name, at, kind).reshape(-1, width)[place[hit]]
        return out

    def scores(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count in training and log10 probability of each token after the one before."""
        m = self.model
        left = _before(flat)
        names, back = np.unique(np.r_[flat, left], return_inverse=True)
        firsts, n = self.find(names, names, "words", ("firsts", "<u4", 1), ("word-counts", "<u8", 1))
        firsts, n = firsts[:, 0], n[:, 0]
        floor = (self._taken(m.words) / max(m.firsts, 1)) / (m.kinds + 1) if m.firsts else 1.0 / (m.kinds + 1)
        low = np.maximum(firsts - discounts(*m.words)[np.minimum(firsts, 3).astype(int)], 0) / max(m.firsts, 1) + floor
        low, count = low[back[: len(flat)]], n[back[: len(flat)]]
        context = np.where(left == START, m.texts, n[back[len(flat):]])

        keys, first, back = np.unique(chained(left, flat), return_index=True, return_inverse=True)
        (seen,) = self.find(keys, left[first], "pairs", ("pair-counts", "u1", 1))
        seen = seen[:, 0]
        big = seen == ESCAPE
        if big.any():
            seen[big] = self.find(keys[big], left[first][big], "large", ("large-counts", "<u8", 1))[0][:, 0]
        seen = seen[back]
        befores, back = np.unique(left, return_inverse=True)
        (followers,) = self.find(befores, befores, "contexts", ("followers", "<u4", 3))
        followers = followers[back]
        followers[context == 1] = (1, 0, 0)
        off = discounts(*m.pairs)
        total = np.maximum(context, 1)
        high = np.maximum(seen - off[np.minimum(seen, 3).astype(int)], 0) / total
        rest = np.where(context > 0, followers @ off[1:] / total, 1.0)
        return count, np.log10(high + rest * low)

    def _taken(self, figures: np.ndarray) -> float:
        """All that the discounts take off the words' numbers of first words."""
        n1, n2 = int(figures[0]), int(figures[1])
        off = discounts(*figures)
        return off[1] * n1 + off[2] * n2 + off[3] * (self.model.kinds - n1 - n2)


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """A model of all texts of ``docs``, in files of the shared folder.

    Each task adds up pairs of about a million tokens and packs them by the hash of
    the first word; one task a shard merges them and writes sorted arrays. Shards
    follow the bytes of text, so a merge is bounded; a frequent pair costs a row
    for each million tokens. Only sums of figures come to the driver.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    folder = shared_folder(docs.sparkSession)
    pairs = _counted(docs, shards).repartition(shards, "shard").groupBy("shard").applyInPandas(
        _write_pairs(folder, shards), f"shard bigint, ends binary, {STATS}")
    rows = pairs.repartition(shards, "shard").groupBy("shard").applyInPandas(_write_words(folder), STATS)
    got = {r["kind"]: r for r in rows.groupBy("kind").agg(
        *[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "kinds", "total")]).collect()}
    figure = lambda kind, name: int(got[kind][name]) if kind in got else 0
    four = lambda kind: np.array([figure(kind, f"n{k}") for k in (1, 2, 3, 4)])
    return Model(folder, shards, four("pairs"), four("words"), figure("words", "kinds"), figure("pairs", "kinds"),
                 figure("words", "total"), figure("pairs", "total"))


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    Needs doc_id, held_out and text. ``score`` is the sum of log10 probabilities of
    a text's words and end; ``base_score`` that of a unigram model with one added
    to each count. Null and empty texts are their end only; equal texts get equal
    scores; an untrained model gives every token the same probability.
    """
    def work(batches):
        reader, known = model.opened(), WordHashes()

        def out(held: list) -> pa.RecordBatch:
            ids, outs, made = zip(*held)
            sizes = np.array([len(t) for t in made])
            count, logs = reader.scores(np.concatenate(made))
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            base = np.log10((count + 1) / (model.tokens + model.kinds + 1))
            add = lambda x: np.add.reduceat(x, starts)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(outs, pa.bool_()), pa.array(sizes, pa.int64()),
                 pa.array(add((count > 0).astype(np.int64)), pa.int64()), pa.array(add(base)), pa.array(add(logs))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        held, size = [], 0
        for ids, outs, texts in texts_of(batches, "doc_id", "held_out", "text"):
            for row in zip(ids, outs, texts):
                made = tokens_of(row[2], known)
                held.append((*row[:2], made))
                size += len(made)
                if size >= TOKENS // 2:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text").mapInArrow(work, RESULT)
    return rows.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from. A fixed rule of the contract."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
