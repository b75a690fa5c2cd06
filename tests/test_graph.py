import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, ranges
from ledgerloom.session import cut
from tests.books import cells


def edge_table(spark, pairs):
    return spark.createDataFrame([("w", a, b) for a, b in pairs], "workbook_id string, src string, dst string")


def all_cycles(pairs):
    """Every elementary cycle by trying all orders; for tiny graphs."""
    nodes, edges = sorted({n for p in pairs for n in p}), set(pairs)
    found = set()
    for size in range(1, len(nodes) + 1):
        for members in itertools.permutations(nodes, size):
            if members[0] == min(members) and all(
                (members[i], members[(i + 1) % size]) in edges for i in range(size)
            ):
                found.add(members)
    return found


def test_edges_of_clean_book(spark):
    book = cells(spark, {
        "Inputs!A1": 100, "Inputs!A2": 200, "P!C1": 10, "P!C2": 20, "P!C3": 30, "P!C4": 40,
        "P!C5": "=SUM(C1:C4)", "P!D1": "=Inputs!A1*2", "P!E1": "=C5+D1",
    })
    got = {(r.src, r.dst) for r in graph.cell_edges(book).collect()}
    assert got == {("P!C5", f"P!C{i}") for i in range(1, 5)} | {
        ("P!D1", "Inputs!A1"), ("P!E1", "P!C5"), ("P!E1", "P!D1")}


def test_ranges_of_every_size_follow_one_rule(spark):
    for last in (4_999, 5_001, 70_000):
        book = cells(spark, {"T!A1": 1, f"T!A{last}": ("=B5", 2), "T!B5": 3, "T!C1": f"=SUM(A1:A{last})", "T!D1": "=SUM($B$1:A2,A1)"})
        got = {(r.src, r.dst) for r in graph.cell_edges(book).collect()}
        assert got == {("T!C1", f"T!A{i}") for i in range(1, last + 1)} | {(f"T!A{last}", "T!B5")} | {
            ("T!D1", f"T!{c}{i}") for c in "AB" for i in (1, 2)}
        assert {(r.src, r.dst) for r in graph.formula_edges(book).collect()} == {("T!C1", f"T!A{last}")}


def test_blocks_make_up_every_interval(spark):
    rng = random.Random(6)
    spans = [(a, a + rng.randrange(0, 64 ** rng.randrange(1, 4) + 1)) for a in (rng.randrange(1, 9_000) for _ in range(60))]
    spans += [(1, 1_048_576), (64, 127), (1, 64), (4096, 8191), (7, 7)]
    df = spark.createDataFrame(spans, "r1 bigint, r2 bigint").select(
        "r1", "r2", ranges.blocks(F.col("r1"), F.col("r2")).alias("b"))
    for r in df.collect():
        at = r.r1
        for b in r.b:
            assert b.row == at == b.block * 64**b.level
            at += 64**b.level
        assert at == r.r2 + 1 and len(r.b) <= 63 * 6 + 4


def test_merged_ranges_and_gaps_against_sets(spark):
    rng = random.Random(9)
    boxes = [("w", f"k{rng.randrange(3)}", "T", c, c + rng.randrange(3), a, a + rng.choice((0, 3, 90, 9_000)))
             for c, a in ((rng.randrange(1, 4), rng.randrange(1, 12_000)) for _ in range(60))]
    rects = spark.createDataFrame(boxes, "workbook_id string, key string, dst_tab string, c1 int, c2 int, r1 int, r2 int")
    want = {(k, c, r) for _, k, _, c1, c2, r1, r2 in boxes for c in range(c1, c2 + 1) for r in range(r1, r2 + 1)}
    covered = ranges.merged(rects, ["workbook_id", "key"]).collect()
    listed = [(m.key, m.col, r) for m in covered for r in range(m.r1, m.r2 + 1)]
    assert len(listed) == len(set(listed)) and set(listed) == want
    held = rng.sample(sorted({(c, r) for _, c, r in want}), 3_000) + [(9, 9)]
    there = spark.createDataFrame([("w", "T", *h) for h in held], "workbook_id string, dst_tab string, col int, row int")
    empty = ranges.gaps(ranges.merged(rects, ["workbook_id", "key"]), there, ["workbook_id", "key"]).collect()
    assert sorted((g.key, g.col, r) for g in empty for r in range(g.r1, g.r2 + 1)) == sorted(w for w in want if w[1:] not in set(held))


def test_reach_and_depth(spark):
    edges = edge_table(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "a")])
    roots = spark.createDataFrame([("w", "a"), ("w", "q")], "workbook_id string, root string")
    got = {(r.root, r.node, r.depth) for r in graph.reach(roots, edges).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("q", "q", 0)}


def test_cycles_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(2):
        nodes = "abcdef"
        pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(11)})
        edges = edge_table(spark, pairs)
        want = all_cycles(pairs)
        rings = graph.components(edges)
        assert {r.node for r in rings.collect()} == {n for c in want for n in c}
        got = [tuple(r.members) for r in graph.elementary_cycles(edges, rings).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_cycle(spark):
    edges = edge_table(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    rings = graph.components(edges)
    assert rings.isEmpty() and graph.elementary_cycles(edges, rings).isEmpty()


def reached(pairs, roots):
    out = set()
    for root in roots:
        seen, front, depth = {root}, [root], 0
        while front:
            out |= {(root, n, depth) for n in front}
            front = sorted({b for a, b in pairs if a in set(front)} - seen)
            seen |= set(front)
            depth += 1
    return out


def components_of(pairs):
    nodes = sorted({n for p in pairs for n in p})
    far = {n: {m for _, m, d in reached(pairs, [n]) if d} | ({n} if (n, n) in pairs else set()) for n in nodes}
    on = {n for n in nodes if any(n == b or n in far[b] for a, b in pairs if a == n)}
    return {frozenset(m for m in on if m == n or (m in far[n] and n in far[m])) for n in on}


@pytest.mark.parametrize("seed", (1, 3))
def test_stretches_rings_and_branches_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = set()
    for _ in range(5):  # paths and rings of unbranched nodes, tied together by a few edges
        names = [f"n{rng.randrange(10_000):04d}" for _ in range(rng.randrange(2, 14))]
        pairs |= set(zip(names, names[1:]))
        if rng.random() < 0.5:
            pairs.add((names[-1], names[0]))
    nodes = sorted({n for p in pairs for n in p})
    pairs |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range(seed * 2)}
    edges = edge_table(spark, sorted(pairs))
    roots = rng.sample(nodes, 4)
    got = graph.reach(spark.createDataFrame([("w", r) for r in roots], "workbook_id string, root string"), edges)
    assert sorted((r.root, r.node, r.depth) for r in got.collect()) == sorted(reached(pairs, roots))
    rings = graph.components(edges)
    groups = {}
    for r in rings.collect():
        groups.setdefault(r.ring, []).append(r.node)
    assert {frozenset(g) for g in groups.values()} == components_of(pairs)
    assert sum(map(len, groups.values())) == len(set().union(*groups.values(), set()))


def test_a_long_chain_and_a_long_ring_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(3_000)]
    ring = [(f"r{i:05d}", f"r{(i + 1) % 3_000:05d}") for i in range(3_000)]
    edges = cut(edge_table(spark, chain + ring))
    roots = spark.createDataFrame([("w", "c00000"), ("w", "c02000")], "workbook_id string, root string")
    got = graph.reach(roots, edges)
    assert got.count() == 3_001 + 1_001 and got.agg({"depth": "max"}).first()[0] == 3_000
    rings = graph.components(edges)
    assert rings.count() == 3_000 and rings.select("ring").distinct().count() == 1
    cycle = graph.elementary_cycles(edges, rings).collect()
    assert [c.members for c in cycle] == [[a for a, _ in ring]]
    assert len(rounds) < 200  # tables written, of all three together


def test_cycles_that_share_members_list_their_stretches(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "x"), ("x", "y"), ("y", "a"), ("d", "d"), ("q", "a"), ("c", "z")]
    edges = edge_table(spark, pairs)
    got = sorted(r.members for r in graph.elementary_cycles(edges, graph.components(edges)).collect())
    assert got == [["a", "b", "c"], ["a", "b", "x", "y"], ["d"]]
