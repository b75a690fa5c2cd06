"""Near-duplicates by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import stored
from ledgerloom.llm.words import WordHashes, chained, fingerprint, hashed, shingles, stirred, texts_of, words

#: Places of the two permutations; coordinates of a signature: BANDS of ROWS.
PLACES, BANDS, ROWS = 1 << 20, 32, 6
BLOCK = 256
#: Passes in which the nodes of a bucket meet one centre.
STARS = 3


class Circulant:
    """All coordinates of a signature from two permutations.

    The first sends a shingle to one of ``PLACES`` places; the second, shifted
    round by k, gives coordinate k. A shingle's values for all k are one stretch
    of the second permutation, so a signature is the minimum over stretches.
    """

    def __init__(self, coordinates: int, seed: int = 5) -> None:
        second = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        round_ = np.concatenate([second, second[:coordinates]])
        self.stretches = np.lib.stride_tricks.sliding_window_view(round_, coordinates)
        self.lift = np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        places = (stirred(numbers ^ self.lift) % np.uint64(PLACES)).astype(np.int64)
        return np.minimum.reduce([self.stretches[places[k : k + 2048]].min(axis=0)
                                  for k in range(0, len(places), 2048)])


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS).astype(np.uint64)
    made = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        made = chained(made, parts[:, k])
    return made.view(np.int64)


SIGNED = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"
SETS = "doc_id bigint, f1 bigint, f2 bigint, shingles array<bigint>"


def _sets(batches, width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    known = WordHashes()
    for ids, texts in texts_of(batches, "doc_id", "text"):
        yield ids, [shingles(hashed(words(t), known), width) for t in texts]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def work(batches):
        minima = Circulant(BANDS * ROWS)
        for ids, sets in _sets(batches, width):
            marks = [fingerprint(s) for s in sets]
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                _lists([_bands(minima(s)) if len(s) else none for s in sets]),
            ], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, SIGNED)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents in ``wanted`` (node, f1, f2), and of no others."""
    def work(batches):
        for ids, sets in _sets(batches, width):
            marks = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                _lists(sets),
            ], ["doc_id", "f1", "f2", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    made = texts.mapInArrow(work, SETS).dropDuplicates(["doc_id", "f1", "f2"])
    return made.join(wanted.select(F.col("node").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).select(
        F.col("doc_id").alias("node"), "shingles")


def _like(common, left, right, percent: int):
    return 100 * common >= percent * (left + right - common)


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links by their full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(b, "b").join(a, "a").filter(
        _like(common, F.size("_a"), F.size("_b"), percent)).select("a", "b")


def _joined(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components among two blocks of one bucket.

    ``sides`` 0 and 1: the two blocks; if only one is there, it meets itself. All
    pairs of different components are compared by their full sets, with one
    product of the blocks' incidence matrices; of the links found, those are
    returned that join what was apart.
    """
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((len(left), len(right)), np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    column = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))
    row_of = np.full((2, len(sets)), -1)
    row_of[0, left], row_of[1, right] = np.arange(len(left)), np.arange(len(right))
    for low in range(0, len(starts), 8192):
        a, z = np.searchsorted(column, [low, low + 8192])
        m = [np.zeros((len(side), 8192), np.float32) for side in (left, right)]
        for k in (0, 1):
            rows = row_of[k, owner[a:z]]
            m[k][rows[rows >= 0], (column[a:z] - low)[rows >= 0]] = 1
        common += np.rint(m[0] @ m[1].T).astype(np.int64)
    linked = _like(common, sizes[left][:, None], sizes[right][None], percent) & (roots[left][:, None] != roots[right][None])
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = top(int(roots[left[i]])), top(int(roots[right[j]]))
        if x != y:
            above[max(x, y)] = min(x, y)
            found.append((int(nodes[left[i]]), int(nodes[right[j]])))
    return found


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, members["node"] == roots["_n"], "left").select(
        *members.columns, F.coalesce("root", "node").alias("root"))


def _pairs_with_centres(members: DataFrame) -> DataFrame:
    """Every node of a bucket with the one of the most company that is in another component than the last centre."""
    centres = members.filter("root <> _last").groupBy("key").agg(
        F.max_by(F.struct("node", "root"), F.struct("_company", -F.col("node"))).alias("c"))
    met = members.join(centres, "key").filter("root <> c.root").select(F.col("node").alias("a"), F.col("c.node").alias("b"))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _outside(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets with several components; ``_last``: the component of the most company."""
    rooted = _rooted(members, roots)
    top = rooted.groupBy("key").agg(
        F.max_by("root", F.struct("_company", -F.col("node"))).alias("_last"),
        F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high")
    return rooted.join(top.select("key", "_last"), "key")


def _remaining(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the comparison with centres left open, between components of one bucket.

    Buckets with the same members are compared once. The largest component of a
    bucket and the rest are dealt to blocks of about ``BLOCK``; every block of the
    rest meets every other block, and no two of the largest component meet.
    """
    apart = _rooted(members, roots)
    held = apart.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("_k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_h"))
    open_ = held.groupBy("key").agg(
        F.count(F.lit(1)).alias("_roots"), F.sum("_k").alias("_rows"), F.sum("_h").alias("_who"),
        F.max("_k").alias("_large"), F.max_by("root", "_k").alias("_top"),
    ).filter((F.col("_roots") > 1) & (F.col("_rows") > 2))
    open_ = open_.groupBy("_rows", "_who").agg(F.min_by(F.struct("key", "_top", "_large"), "key").alias("o")).select(
        "o.key", "o._top", F.ceil(F.col("o._large") / BLOCK).cast("int").alias("_own"),
        F.ceil((F.col("_rows") - F.col("o._large")) / BLOCK).cast("int").alias("_else"))
    within = F.col("root") == F.col("_top")
    at = F.pmod(F.xxhash64("node"), F.when(within, F.col("_own")).otherwise(F.col("_else"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda kind, i, j, side: F.struct(
        F.lit(kind).alias("kind"), i.alias("_i"), j.alias("_j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    # the largest component meets the rest; the rest meets itself
    meets = F.when(within, F.transform(upto("_else"), lambda j: group(0, F.col("_at"), j, 1))).otherwise(F.concat(
        F.transform(upto("_own"), lambda i: group(0, i, F.col("_at"), 0)),
        F.transform(upto("_else"), lambda j: group(1, F.least("_at", j), F.greatest("_at", j), (F.col("_at") > j).cast("int")))))
    dealt = apart.join(open_, "key").withColumn("_at", at).select("key", "node", "root", F.inline(meets))
    rows = dealt.join(sets, "node").repartition("key", "kind", "_i", "_j").sortWithinPartitions("key", "kind", "_i", "_j", "side")

    def work(batches):
        held, at = [], None

        def done():
            nodes, roots, sides, own = zip(*held)
            return _joined(np.array(nodes), np.array(roots), np.array(sides), list(own), percent)

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            pairs = []
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("key", "kind", "_i", "_j", "node", "root", "side")]
            own = batch.column(batch.schema.get_field_index("shingles"))
            ends, flat = np.asarray(own.offsets), np.asarray(own.values)
            for k, (*group, node, root, side) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if group != at:
                    if len(held) > 1:
                        pairs += done()
                    held, at = [], group
                held.append((node, root, side, flat[ends[k]:ends[k + 1]].copy()))
            yield out(pairs)
        if len(held) > 1:
            yield out(done())

    return rows.mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Needs doc_id and text. Sets of ``width``-word shingles are linked from
    ``percent`` Jaccard similarity on; component_id is the smallest doc_id
    reachable, and kept marks it. Signatures have ``BANDS`` bands of ``ROWS``
    values: at 80 % a pair shares no band about 6 times in 100,000.

    Equal sets are one node. In each bucket every node meets the one with the most
    company, exactly, and in two more passes one of another component; a last pass
    compares, in blocks, all nodes of a bucket that are still in different
    components. So no candidate pair goes unchecked and no
    bucket is cut, yet a large group costs its size.

    Texts without words (null, empty, blank) have an empty set and stay alone. Rows
    that share a doc_id are one document: linked, each with its own set size. A
    null doc_id takes no part: component_id null, kept true. An empty table gives
    an empty result.
    """
    marked = stored(signatures(docs, width))
    taking = marked.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = stored(taking.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")))
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = stored(spread.join(shared, "key").distinct())
    company = members.groupBy("node").agg(F.sum("_n").alias("_company"))
    members = stored(members.select("node", "key").join(company, "node"))

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "f1", "f2")
    sets = stored(_sets_of(docs, wanted, width))
    same = taking.join(nodes.select("f1", "f2", "node"), ["f1", "f2"]).select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    links, roots = None, None
    for _ in range(STARS):
        now = members.withColumns({"root": F.col("node"), "_last": F.lit(-1) - F.abs("node")}) if roots is None else _outside(members, roots)
        found = stored(_checked(_pairs_with_centres(now), sets, percent))
        links = found if links is None else links.unionByName(found)
        roots = components(links).select(F.col("node").alias("_n"), "root")
    more = _remaining(members, roots, sets, percent)
    final = components(
        roots.select(F.col("_n").alias("a"), F.col("root").alias("b")).unionByName(more).unionByName(same)
    ).select(F.col("node").alias("doc_id"), "root")
    return marked.join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
        (F.col("doc_id").isNull() | (F.coalesce("root", "doc_id") == F.col("doc_id"))).alias("kept"))
