"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.shared import stored

K1, B = 1.2, 0.75
#: Words of an index entry; a passage is two of them, half overlapping the next.
SPAN = 64
#: Part of an entry's own score that a passage must reach; overlap of question and answer.
THRESHOLD, OVERLAP, SHINGLE = 0.7, 0.8, 5
#: Postings of an index shard, and of a block with its own highest impact.
#: Ranges of entries in which each term's highest impact is known.
SHARD, BLOCK, RANGES = 200_000, 32, 64

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks and blanks separate them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's sentences but the last that holds words, and of that one."""
    parts = [w for w in map(words, re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    return [w for p in parts[:-1] for w in p], parts[-1] if parts else []


def overlap(part: list[bytes], there: list[bytes]) -> float:
    """Share of the ``SHINGLE``-word runs of ``part`` (or of it whole) that ``there`` has."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = runs(part)
    return len(wanted & runs(there)) / len(wanted)


def spans(found: list[bytes]) -> list[list[bytes]]:
    """Entries of an item: stretches of ``SPAN`` words, the last up to half longer."""
    cuts = list(range(0, max(len(found) - SPAN // 2, 1), SPAN))
    return [found[a:z] for a, z in zip(cuts, [*cuts[1:], len(found)])]


class Shard:
    """Inverted index of some entries: impacts by entry, highest by term and by block.

    An impact is a term's BM25 weight as a share of the entry's own score.
    """

    def __init__(self, postings: list[tuple[int, bytes, float]], items: list[tuple[int, str]], owner: list[int]) -> None:
        self.items, self.owner = items, owner
        self.parts = [question_and_answer(text) for _, text in items]
        self.terms: dict[bytes, int] = {}
        rows: list[list[tuple[int, float]]] = []
        for entry, term, impact in sorted(postings):
            at = self.terms.setdefault(term, len(rows))
            if at == len(rows):
                rows.append([])
            rows[at].append((entry, impact))
        self.entries = [np.array([e for e, _ in r]) for r in rows]
        self.impacts = [np.array([i for _, i in r]) for r in rows]
        self.blocks = [np.maximum.reduceat(i, np.arange(0, len(i), BLOCK)) for i in self.impacts]
        self.highest = np.array([i.max() for i in self.impacts] + [0.0])
        self.ranges = np.zeros((len(rows) + 1, min(RANGES, len(owner))), np.float32)
        for t, (entries, impacts) in enumerate(zip(self.entries, self.impacts)):
            np.maximum.at(self.ranges[t], entries * self.ranges.shape[1] // len(owner), impacts)

    def search(self, terms: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All entries from ``low`` to before ``high`` whose impacts over ``terms`` reach ``threshold``.

        By block-max WAND; without bounds, over all entries.
        """
        found = []
        high = len(self.owner) if high is None else high
        at = {t: int(np.searchsorted(self.entries[t], low)) if low else 0 for t in terms}
        live = list(terms)
        while True:
            live = [t for t in live if at[t] < len(self.entries[t]) and self.entries[t][at[t]] < high]
            live.sort(key=lambda t: self.entries[t][at[t]])
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.highest[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            entry = self.entries[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.entries[live[pivot + 1]][at[live[pivot + 1]]] == entry:
                pivot += 1
            ahead = live[: pivot + 1]
            place = {t: at[t] + int(np.searchsorted(self.entries[t][at[t] :], entry)) for t in ahead}
            held = {t: place[t] // BLOCK for t in ahead if place[t] < len(self.entries[t])}
            if sum(self.blocks[t][b] for t, b in held.items()) >= threshold - 1e-9:
                here = [t for t in held if self.entries[t][place[t]] == entry]
                score = float(sum(self.impacts[t][place[t]] for t in here))
                if score >= threshold - 1e-9:
                    found.append((int(entry), score))
                for t in ahead:
                    at[t] = place[t] + (t in here)
                continue
            ends = [int(self.entries[t][min((b + 1) * BLOCK, len(self.entries[t])) - 1]) + 1 for t, b in held.items()]
            if pivot + 1 < len(live):
                ends.append(int(self.entries[live[pivot + 1]][at[live[pivot + 1]]]))
            target = max(min(ends), int(entry) + 1)
            for t in ahead:
                at[t] += int(np.searchsorted(self.entries[t][at[t] :], target))

    def leaks(self, text: str | None, threshold: float) -> list[tuple[int, float, float, float]]:
        """Items whose question and answer a text holds: item_id, score, both overlaps."""
        found = words(text)
        if not found:
            return []
        terms = np.fromiter(map(self.terms.get, found, [-1] * len(found)), np.int64, len(found))
        total = np.concatenate([[0.0], np.cumsum(self.highest[terms])])
        starts = np.arange(0, max(len(found) - 3 * SPAN // 2, 1), SPAN // 2)
        ends = np.minimum(starts + 2 * SPAN, len(found))
        best: dict[int, float] = {}
        n = self.ranges.shape[1]
        # no entry can get more than the sum of the highest impacts of its words
        for k in np.flatnonzero(total[ends] - total[starts] >= threshold - 1e-9):
            here = np.unique(terms[starts[k] : ends[k]])
            highest = self.ranges[here]
            # nor in any range of entries more than the sum of their highest there
            for part in np.flatnonzero(highest.sum(axis=0) >= threshold - 1e-6):
                held = here[(here >= 0) & (highest[:, part] > 0)]
                low, high = (-(-r * len(self.owner) // n) for r in (part, part + 1))
                for entry, score in self.search(held.tolist(), threshold, low, high):
                    item = self.owner[entry]
                    best[item] = max(score, best.get(item, 0.0))
        out = []
        for item, score in best.items():
            question, answer = self.parts[item]
            q, a = overlap(question, found), overlap(answer, found)
            if q >= OVERLAP and a >= OVERLAP:
                out.append((self.items[item][0], score, q, a))
        return sorted(out)


def shards(items: DataFrame) -> Iterator[Shard]:
    """The index of ``items`` (item_id, text), in parts of about ``SHARD`` postings.

    Spark counts terms, document frequencies and impacts; only one part at a time
    comes to the driver, to be sent to all tasks, so both are bounded however
    many items there are. Items without words are in no part.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                for n, span in enumerate(spans(words(text))):
                    rows += [(item, text, n, term, tf, len(span)) for term, tf in Counter(span).items()]
            yield pd.DataFrame(rows, columns=["item_id", "text", "entry", "term", "tf", "size"])

    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    terms = items.mapInPandas(cut, "item_id bigint, text string, entry int, term binary, tf int, size int")
    key = ["item_id", "text", "entry"]
    facts = terms.groupBy(*key).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    entries, average, postings = facts.agg(F.count(F.lit(1)), F.avg("size"), F.sum("n")).first()
    if not entries:
        return
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (entries - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / average))
    weighed = terms.join(df, "term").withColumn("weight", weight)
    own = weighed.groupBy(*key).agg(F.sum("weight").alias("own"))
    n = -(-postings // SHARD)
    ready = stored(weighed.join(own, key).select(
        *key, "term", (F.col("weight") / F.col("own")).alias("impact"), F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("shard")))
    for k in range(n):
        items_at, entries_at, rows = {}, {}, []
        owner: list[int] = []
        for r in ready.filter(F.col("shard") == k).drop("shard").orderBy("item_id", "text", "entry", "term").collect():
            item = items_at.setdefault((r["item_id"], r["text"]), len(items_at))
            entry = entries_at.setdefault((item, r["entry"]), len(owner))
            if entry == len(owner):
                owner.append(item)
            rows.append((entry, bytes(r["term"]), r["impact"]))
        if rows:
            yield Shard(rows, list(items_at), owner)


FOUND = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


def leaks(text: Column, shard, threshold: float = THRESHOLD) -> Column:
    """Items of a broadcast ``Shard`` that a whole text leaks; empty for null and empty texts."""
    @F.pandas_udf(FOUND)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "score", "question", "answer"), x))
                              for x in shard.value.leaks(t, threshold)] for t in texts], dtype="object")

    return look(text)


def with_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``leaks``, the items that each text holds.

    Passages of 2 x ``SPAN`` words, each half a span further, query the index. All
    entries above ``threshold`` of their own BM25 score are retrieved; an item is a
    leak if the text holds ``OVERLAP`` of the ``SHINGLE``-word runs of its question
    (all sentences but the last) and of its answer (the last one; shorter ones
    whole). Items of one sentence have no question. A column named leaks is
    replaced; without items nothing leaks.
    """
    spark = docs.sparkSession
    none = F.array().cast(FOUND)
    columns = [leaks(F.col("text"), spark.sparkContext.broadcast(s), threshold) for s in shards(items)]
    return docs.withColumn("leaks", F.concat(none, *columns) if columns else none)
