"""Plans that must not deal all rows again and again."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cells as C, graph, numbering, ranges
from ledgerloom.operators.numbering import numbered
from ledgerloom.plans import queries
from ledgerloom.session import FACTOR, UNPACKED, cut


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def dealings(df):
    """How often the plan before it runs deals rows by a hash."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_numbers_deal_rows_once(spark, no_broadcast):
    rows = spark.createDataFrame(
        [(w, t, r) for w in ("a", "b", None) for t in (2, 1, None) for r in (3, 1, 2)], "w string, t int, r int")
    made = numbered(rows, ["w"], [F.col("t")], [F.col("r")], "no")
    # the rows, and the pieces for their counts, their running totals and the join
    assert dealings(made) == 4
    assert made.columns == ["w", "t", "r", "no"]
    order = {w: sorted(((t is not None, t or 0, r), n) for w2, t, r, n in made.collect() if w2 == w) for w in ("a", "b", None)}
    assert [[n for _, n in order[w]] for w in order] == [list(range(1, 10))] * 3


def test_ranges_of_formulas_are_dealt_once(spark):
    rects = spark.createDataFrame(
        [("w", "T!A1", "T", 1, 1, 1, 5), ("w", "T!A1", "T", 1, 1, 3, 9), ("w", "T!A1", "T", 1, 1, 3, 9), ("w", "T!B1", "T", 1, 2, 4, 4)],
        "workbook_id string, src string, dst_tab string, c1 int, c2 int, r1 int, r2 int")
    made = ranges.merged(rects, ["workbook_id", "src"])
    assert dealings(made) == 1
    found = sorted((r.src, r.col, r.r1, r.r2) for r in made.collect())
    assert found == [("T!A1", 1, 1, 5), ("T!A1", 1, 6, 9), ("T!B1", 1, 4, 4), ("T!B1", 2, 4, 4)]


def test_small_files_are_not_taken_for_small_tables(spark):
    spark.conf.unset(FACTOR)
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    kept = cut(spark.range(20_000).select((F.col("id") % 7).cast("string").alias("s")))
    assert float(spark.conf.get(FACTOR)) == UNPACKED
    taken = size(kept)
    spark.conf.set(FACTOR, "1.0")
    assert taken > 20 * size(spark.read.parquet(kept.inputFiles()[0]))
    spark.conf.unset(FACTOR)


def item_joins_and_windows(df):
    """Joins and windows that the optimized plan of a table still has."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join "), plan.count("Window ")


def order_tables(spark, folder):
    """Three orders with items, one of them repeated, with a price that is null, and one without."""
    orders = [(k, 1, "P" if k == 2 else "F", 100.0 * k, p) for k, p in ((1, "1-URGENT"), (2, "3-MEDIUM"), (3, "5-LOW"), (4, "5-LOW"))]
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    ).write.parquet(f"{folder}/orders.parquet")
    items = [(k, n, 7, 1, price, 0.1, "R" if n == 2 else "N") for k, last in ((1, 3), (2, 1), (3, 2)) for n, price in
             ((i, 10.0 * i if i < 3 else None) for i in range(1, last + 1))]
    spark.createDataFrame(
        items + items[:1], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double,"
        " l_discount double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_ledger_lines_are_written_before_labels_are_proposed(spark, tmp_path, monkeypatch):
    folder, given = order_tables(spark, tmp_path), []
    propose = queries.match.propose
    monkeypatch.setattr(queries.match, "propose", lambda lines, outputs: given.extend((lines, outputs)) or propose(lines, outputs))
    found = queries.label_mappings(spark, folder).select("report_id", "mapping_id", "output_ref").collect()
    assert item_joins_and_windows(given[0]) == (0, 0)
    assert {(r.report_id, r.mapping_id, r.output_ref) for r in found} == {
        ("wb-1", "MAP-0001", "Lines!B5"), ("wb-1", "MAP-0002", "Summary!B1"),
        ("wb-2", "MAP-0001", "Lines!B2"), ("wb-2", "MAP-0002", "Summary!B1"),
        ("wb-3", "MAP-0001", "Lines!B3"), ("wb-3", "MAP-0002", "Summary!B1")}


def test_cycles_write_formulas_alone(spark, tmp_path, monkeypatch):
    folder, written = order_tables(spark, tmp_path), []
    monkeypatch.setattr(queries, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = queries.circular_references(spark, folder).collect()
    assert [(r.workbook_id, r.tab_key, r.cell_ref) for r in found] == [("wb-2", "Summary", "C1")]
    # net lines (4, 1 and 2), totals, sums with charge, and the ring of the second order
    assert written[0].count() == 4 + 1 + 2 + 3 + 3 + 2
    assert written[0].columns == ["workbook_id", "tab_key", "col", "row", "node", "formula"]


def test_outputs_of_the_rebuild_are_written_once(spark, tmp_path):
    c, _, done = queries._rebuilt(spark, order_tables(spark, tmp_path))
    assert item_joins_and_windows(c.outputs) == (0, 0)
    assert {(r.workbook_id, r.root) for r in done.summary.collect()} == {
        (f"wb-{k}", ref) for k, n in ((1, 4), (2, 1), (3, 2)) for ref in (f"Lines!B{n + 1}", "Summary!B1")}


def test_repeats_are_looked_for_among_edges_of_rings_only(spark, monkeypatch):
    plans, write = [], graph.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    edges = cut(spark.createDataFrame(
        [("w", "a", "b"), ("w", "b", "a"), ("w", "b", "a"), ("w", "c", "a"), ("w", None, "a")], "workbook_id string, src string, dst string"))
    rings = cut(spark.createDataFrame([("w", "a", "b"), ("w", "b", "b")], "workbook_id string, node string, ring string"))
    monkeypatch.setattr(graph, "cut", seen)
    found = graph.elementary_cycles(edges, rings)
    assert plans[0].startswith("Aggregate") and plans[0].count("Aggregate") == 1
    assert [r.members for r in found.collect()] == [["a", "b"]]


def test_places_by_reference_deal_small_tabs_once(spark, no_broadcast, monkeypatch):
    rows = [(w, t, f"{c}{r}", f, float(r)) for w in ("a", None) for t in ("T", None) for c in ("A", "AA", "B") for r in (2, 1, 10, 100)
            for f in ("=A1", None)]
    cells = spark.createDataFrame(rows, "workbook_id string, tab_key string, cell_ref string, formula string, value_num double").selectExpr(
        "*", "string(null) value_text", "boolean(null) value_bool")
    made = C.by_reference(cells)
    assert dealings(made) == 1
    found = sorted(map(repr, made.collect()))
    refs = [r.cell_ref for r in made.filter("workbook_id = 'a' and tab_key = 'T'").orderBy("position").collect()]
    assert refs == sorted(refs) and len(refs) == 24
    assert [r.n for r in made.groupBy("workbook_id", "tab_key").agg(F.max("position").alias("n")).collect()] == [24] * 4
    monkeypatch.setattr(numbering, "HELD", 23)
    assert sorted(map(repr, C.by_reference(cells.unionByName(cells.filter("workbook_id = 'a'").limit(1).withColumn("tab_key", F.lit("few")))).filter(
        "not tab_key <=> 'few'").collect())) == found
