"""Toxicity: averaged subword embeddings in a linear softmax, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS, SIZE = 1 << 17, 4
#: Words in a window; labelled documents of each class and their windows that are learned from.
WINDOW, SAMPLE, SAMPLE_WINDOWS = 8, 1500, 60
#: Documents that a subword must be in; rounds over all windows, times the best ones are chosen, rounds over those.
MIN_DOCS, ROUNDS, RATE = 20, (15, 4, 15), 0.3
OUTER = ".,;:!?\"'()[]{}|<>«»„“”‘’-_*~`"


def runs(word: str) -> set[str]:
    """A word's runs of 3 to 5 characters, with marks at its ends.

    The whole word is none of them, so that a misspelt one is never far off.
    """
    marked = f"<{word}>"
    return {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}


def bucket(run: str) -> int:
    return xxhash.xxh3_64_intdigest(run.encode("utf-8", "surrogatepass")) % BUCKETS


def subwords(word: str) -> list[int]:
    return [bucket(r) for r in sorted(runs(word))]


def words(text: str | None) -> list[str]:
    """Lower-cased words without the marks around them."""
    return [w for w in (x.strip(OUTER) for x in (text or "").lower().split()) if w]


@dataclass
class Model:
    """A weight for each bucket, and what turns a document's best window into a score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    empty: float

    def score(self, best: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


class RunWeights(dict):
    """Weights of runs of characters, remembered for a bounded number of them."""

    LIMIT = 1 << 19

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, run: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        made = self[run] = float(self.model.weights[bucket(run)])
        return made


class WordScores(dict):
    """Scores of words as written, remembered for a bounded number; nan for bare marks."""

    LIMIT = 1 << 19

    def __init__(self, model: Model) -> None:
        self.model, self.runs = model, RunWeights(model)

    def __missing__(self, written: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        word = written.strip(OUTER)
        parts = sorted(runs(word)) if word else []
        made = self[written] = sum(map(self.runs.__getitem__, parts)) / len(parts) if parts else float("nan")
        return made

    def best(self, text: str | None) -> float | None:
        """Highest average over any ``WINDOW`` words in a row, or over all if fewer."""
        found = (text or "").lower().split()
        told = np.fromiter(map(self.__getitem__, found), np.float64, len(found))
        told = told[~np.isnan(told)]
        if not len(told):
            return None
        width = min(WINDOW, len(told))
        total = np.concatenate([[0.0], np.cumsum(told)])
        return float((total[width:] - total[:-width]).max()) / width + self.model.bias


class Bags:
    """Sums over ragged groups of members, and the way back from groups to members."""

    def __init__(self, groups: list[np.ndarray], members: int) -> None:
        self.sizes = np.array([len(g) for g in groups], np.float32)[:, None]
        self.flat = np.concatenate(groups)
        self.starts = np.r_[0, np.cumsum([len(g) for g in groups])[:-1]].astype(np.int64)
        order = np.argsort(self.flat, kind="stable")
        self.owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[order]
        self.present, self.back = np.unique(self.flat[order], return_index=True)
        self.members = members

    def means(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.flat], self.starts, axis=0) / self.sizes

    def gradient(self, of_means: np.ndarray) -> np.ndarray:
        made = np.zeros((self.members, of_means.shape[1]), np.float32)
        made[self.present] = np.add.reduceat((of_means / self.sizes)[self.owner], self.back, axis=0)
        return made


class Softmax:
    """Subword embeddings and a linear softmax over their averages."""

    def __init__(self, spelt: Bags, seen: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        self.spelt = spelt
        # chance moves a subword's gradient by the root of how often it is seen
        self.scales = [1 / np.sqrt(np.maximum(seen, 1)).astype(np.float32)[:, None], 1.0, 1.0]
        self.values = [rng.normal(0, 0.1, (spelt.members, SIZE)).astype(np.float32),
                       rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.moments = [[np.zeros_like(x), 0.0] for x in self.values]
        self.step = 0

    def train(self, windows: Bags, labels: np.ndarray, weights: np.ndarray, rounds: int) -> None:
        """Full-batch descent. A subword moves by how far its gradient is from chance, so neither rare nor common ones lead."""
        want = np.eye(2, dtype=np.float32)[labels]
        for _ in range(rounds):
            self.step += 1
            embed, soft, bias = self.values
            hidden = windows.means(self.spelt.means(embed))
            out = hidden @ soft + bias
            out = np.exp(out - out.max(axis=1)[:, None])
            miss = (out / out.sum(axis=1)[:, None] - want) * weights[:, None]
            grads = (self.spelt.gradient(windows.gradient(miss @ soft.T)), hidden.T @ miss, miss.sum(axis=0))
            for x, raw, scale, moment in zip(self.values, grads, self.scales, self.moments):
                g = raw * scale
                moment[0] += 0.1 * (g - moment[0])
                moment[1] += 0.01 * (float((g * g).max()) - moment[1])
                x -= RATE * (moment[0] / (1 - 0.9**self.step)) / (np.sqrt(moment[1] / (1 - 0.99**self.step)) + 1e-12)

    def contrast(self) -> tuple[np.ndarray, float]:
        """What each subword adds for label 1 against label 0, and the bias."""
        embed, soft, bias = self.values
        return embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def fit(windows: list[list[str]], labels: np.ndarray, docs: np.ndarray, totals: tuple[int, int] | None = None) -> Model:
    """Embeddings and softmax learned together from labelled windows.

    A window is the average of its words, a word the average of its subwords.
    Subwords of fewer than ``MIN_DOCS`` documents weigh nothing. First all windows
    take their document's label, then only the highest one of each document. Both
    classes weigh the same; the final curve follows ``totals``, the number of
    labelled documents of each class.
    """
    rate = float(np.mean(labels)) if len(labels) else 0.0
    flat = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), rate)
    if len(set(labels.tolist())) < 2:
        return flat
    _, doc = np.unique(docs, return_inverse=True)
    n_docs = int(doc.max()) + 1
    label = np.zeros(n_docs, np.int64)
    label[doc] = labels
    names = sorted({w for x in windows for w in x})
    place = {w: i for i, w in enumerate(names)}
    told = [np.array([place[w] for w in x]) for x in windows]
    parts = [np.array(subwords(w)) for w in names]
    in_doc = np.unique(np.repeat(doc, [len(t) for t in told]) * np.int64(len(names)) + np.concatenate(told))
    seen = np.bincount(np.concatenate(parts), np.repeat(np.bincount(in_doc % len(names), minlength=len(names)), [len(p) for p in parts]), BUCKETS)
    common = np.flatnonzero(seen >= min(MIN_DOCS, n_docs // 10 + 1))
    if not len(common):
        return flat
    column = np.full(BUCKETS, len(common))  # the last one stands for all rare subwords
    column[common] = np.arange(len(common))
    softmax = Softmax(Bags([column[p] for p in parts], len(common) + 1), np.append(seen[common], seen.sum()))

    def balanced(of: np.ndarray) -> np.ndarray:
        weigh = 1.0 / np.bincount(of, minlength=n_docs)[of]
        sums = np.bincount(label[of], weigh, 2)
        return (weigh / sums[label[of]] / 2).astype(np.float32)

    everything = Bags(told, len(names))
    softmax.train(everything, labels, balanced(doc), ROUNDS[0])
    for _ in range(ROUNDS[1]):
        weights, bias = softmax.contrast()
        weights[-1] = 0
        score = everything.means(softmax.spelt.means(weights[:, None]))[:, 0]
        order = np.lexsort((score, doc))
        top = order[np.r_[doc[order][1:] != doc[order][:-1], True]]
        softmax.train(Bags([told[i] for i in top], len(names)), label, balanced(doc[top]), ROUNDS[2])
    weights, bias = softmax.contrast()
    weights[-1] = 0
    best = np.full(n_docs, -np.inf)
    np.maximum.at(best, doc, everything.means(softmax.spelt.means(weights[:, None]))[:, 0] + bias)
    whole = np.zeros(BUCKETS, np.float32)
    whole[common] = weights[:-1]
    return _set_against(Model(whole, bias, 1.0, 0.0, 0.0), best, label, totals)


def _set_against(model: Model, best: np.ndarray, label: np.ndarray, totals: tuple[int, int] | None) -> Model:
    """Slope and offset of a logistic curve through best windows and labels, by Newton steps."""
    middle, width = float(best.mean()), float(best.std()) or 1.0
    x = np.stack([(best - middle) / width, np.ones_like(best)], axis=1)
    drawn = np.bincount(label, minlength=2)
    weigh = (np.array(totals or drawn) / np.maximum(drawn, 1))[label]
    weigh = weigh * len(label) / weigh.sum()
    beta = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weigh * (p - label)) + 1e-2 * beta
        curve = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta -= np.linalg.solve(curve, slope)
    model.slope, model.offset = float(beta[0] / width), float(beta[1] - beta[0] * middle / width)
    low = float(np.percentile(best[label == 0], 50))
    model.empty = float(min(model.score(low), 0.49))
    return model


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_windows: int = SAMPLE_WINDOWS) -> Model:
    """A model from at most ``sample`` labelled documents of each class.

    ``labels``: doc_id and label (0, 1; others are left out; repeated rows count as 1
    if any does). Documents are drawn by the hash of their id, and at most
    ``sample_windows`` windows of each, from its whole text, by a seeded draw, so
    what meets in the one training task is bounded.
    """
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    of = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    totals = (of.get(0, 0), of.get(1, 0))
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, label in zip(batch["doc_id"], batch["text"], batch["label"]):
                found = words(text)
                places = np.arange(0, len(found), WINDOW)
                if len(places) > sample_windows:
                    places = np.random.default_rng(int(doc) % (1 << 32)).choice(places, sample_windows, replace=False)
                rows += [(doc, label, " ".join(found[p : p + WINDOW])) for p in sorted(places.tolist())]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "window"])

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"doc_id": [], "label": [], "window": []})])
        rows = rows.sort_values(["doc_id", "window"], kind="stable")
        model = fit([w.split(" ") for w in rows["window"]], rows["label"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64), totals)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    cuts = texts.mapInPandas(cut, "doc_id bigint, label int, window string")
    return pickle.loads(cuts.repartition(1).mapInPandas(train, "model binary").first()["model"])


def toxicity(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1; a text without words gets a low constant."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = WordScores(model)
        for texts in batches:
            best = [scores.best(t) for t in texts]
            yield pd.Series([model.empty if b is None else float(model.score(b)) for b in best], dtype="float64")

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from. A fixed rule of the contract."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted; needs doc_id and text.

    Only the text decides a score: null and empty texts get one low constant, equal
    texts equal scores. ``labels``: doc_id and toxic; without labels of both classes
    all texts get the same score. Columns named like the three are replaced.
    """
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(~held_out(F.col("doc_id")))
    model = learned(docs, learn)
    return docs.withColumns({
        "held_out": held_out(F.col("doc_id")),
        "score": toxicity(F.col("text"), model),
    }).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
