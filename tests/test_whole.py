"""Workbooks worked off whole give the rows of the distributed steps, in few tables."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import cells as C, graph, rebuild, whole
from ledgerloom.session import cut
from tests.books import cells, outputs

BLOCKS = {f"T!A{i}": i / 7 for i in range(1, 300) if i % 9} | {"T!A128": ("=B1*2", 1.0), "T!A150": ("=A128", 0), "T!B1": 0.1}
BOOKS = {
    "blocks": (BLOCKS | {"T!C1": ("=SUM(A1:A299)", 0), "T!C2": ("=SUM(A60:B5000,A1)", 0), "T!C3": ("=C1/C2-SUM(A$1:A$64)", 0)},
               ["T!C1", "T!C2", "T!C3", "T!Z9", "T!B1"]),
    "texts": ({"T!A1": "note", "T!A2": True, "T!A3": 2.0, "T!B1": ("=A1+1", 0), "T!B2": ("=SUM(A1:A3)", 0), "T!B3": ("=A3+A9", 0),
               "My Tab!A1": ("='T'!$A$3*-T!B3", 0), "T!B4": ("=ABS(A3)", 0), "T!B5": ("=B4+1+B3/0", 0), "T!B6": ("=B3/(A3-2)", 0)},
              ["T!B1", "T!B2", "T!B3", "My Tab!A1", "T!B5", "T!B6", "T!A1"]),
    "rings": ({"T!A1": ("=A2", 1), "T!A2": ("=A3", 1), "T!A3": ("=A1+B1", 1), "T!B1": ("=B1", 1), "T!C1": ("=A1+D1", 1), "T!D1": 2,
               "T!E1": ("=C1+F1", 0), "T!F1": ("=D1*D1", 4)}, ["T!E1", "T!A2", "T!F1", "T!B1"]),
}


def tables(spark):
    made = [cells(spark, book, name) for name, (book, _) in BOOKS.items()]
    # a book that names a cell twice, and one whose name is null
    twice = {"T!A1": 1.0, "T!B1": ("=SUM(A1)+1", 2.0)}
    made += [cells(spark, twice, "twice"), cells(spark, {"T!A1": 5.0}, "twice"), cells(spark, twice, None)]
    chosen = [outputs(spark, *refs, workbook_id=name) for name, (_, refs) in BOOKS.items()]
    chosen += [outputs(spark, "T!B1", workbook_id=name) for name in ("twice", None)]
    return (cut(reduce(DataFrame.unionByName, x)) for x in (made, chosen))


def plain(df, columns):
    """Rows with numbers to twelve digits: maps of one unknown may round differently."""
    short = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    return sorted((tuple(short(r[c]) for c in columns) for r in df.collect()), key=repr)


def found(book, chosen):
    edges = cut(graph.formula_edges(book))
    done = rebuild.rebuild(book, edges, chosen)
    frames = {
        "edges": edges, "summary": done.summary, "steps": rebuild.derivations(done), "chains": done.chains, "nodes": done.nodes,
        "gaps": done.gaps}
    return {name: plain(frame, frame.columns) for name, frame in frames.items()}


def test_whole_workbooks_equal_the_distributed_steps(spark, monkeypatch):
    book, chosen = tables(spark)
    here = found(book, chosen)
    monkeypatch.setattr(whole, "HELD", 0)
    there = found(book, chosen)
    assert here.keys() == there.keys()
    for name in here:
        assert here[name] == there[name], name
    assert {r[0] for r in here["summary"]} == {*BOOKS, "twice"}


def test_some_books_are_whole_and_others_not(spark, monkeypatch):
    book, chosen = tables(spark)
    want = plain(graph.formula_edges(book), graph.EDGE)
    monkeypatch.setattr(whole, "HELD", 60)  # "blocks" has more rows
    assert plain(graph.formula_edges(book), graph.EDGE) == want


def test_small_workbooks_are_rebuilt_in_few_tables(spark, monkeypatch):
    book = cut(cells(spark, BOOKS["texts"][0]).unionByName(cells(spark, BOOKS["rings"][0], "v")))
    chosen = cut(outputs(spark, "T!B2").unionByName(outputs(spark, "T!E1", workbook_id="v")))
    edges, written = cut(graph.formula_edges(book)), []
    for module in (rebuild, whole, graph, rebuild.ranges):
        monkeypatch.setattr(module, "cut", lambda df: written.append(1) or cut(df))
    assert rebuild.rebuild(book, edges, chosen).summary.count() == 2
    assert len(written) == 2


def test_cycles_of_one_workbook():
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("g", "g"), ("x", "a"), ("d", "h")]
    assert whole.cyclic_nodes(edges) == {"a", "b", "c", "e", "f", "g"}
    long = [(f"n{i}", f"n{i + 1}") for i in range(30_000)]
    assert whole.cyclic_nodes(long) == set()
    assert len(whole.cyclic_nodes([*long, ("n30000", "n0")])) == 30_001


def test_deep_and_wide_books_within_the_limit(spark):
    last = 2_000
    rows = spark.range(1, last + 1).withColumn("row", F.col("id").cast("int"))
    text = F.col("row").cast("string")
    col = lambda n, formula, num: rows.select(
        F.lit("w").alias("workbook_id"), F.lit("T").alias("tab_key"), F.lit(n).alias("col"), "row", formula.cast("string").alias("formula"),
        num.cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("boolean").alias("value_bool"),
        F.concat(F.lit(f"T!{'AB'[n - 1]}"), text).alias("node"))
    book = cut(col(1, F.lit(None), F.col("row")).unionByName(
        col(2, F.when(F.col("row") == 1, F.lit("=A1")).otherwise(F.concat(F.lit("=B"), (F.col("row") - 1).cast("string"), F.lit("+SUM(A1:A"), text, F.lit(")"))), F.lit(0))))
    done = rebuild.rebuild(book, cut(graph.formula_edges(book)), outputs(spark, f"T!B{last}"))
    row = done.summary.first()
    assert row.value == sum(n * (n + 1) / 2 for n in range(1, last + 1)) and row.chain_nodes == 2 * last
    assert done.spread is None


def test_unit_of_given_cycles(spark):
    book = cut(cells(spark, BOOKS["rings"][0]))
    edges = cut(graph.formula_edges(book))
    given = rebuild.rebuild(book, edges, outputs(spark, "T!E1"), graph.components(edges)).summary
    assert plain(given, given.columns) == plain(rebuild.rebuild(book, edges, outputs(spark, "T!E1")).summary, given.columns)
    assert given.first().value is None


@pytest.mark.parametrize("formula, boxes", [
    ("='My Tab'!$B$2:A1+x!C3", [("My Tab", 1, 2, 1, 2), ("x", 3, 3, 3, 3)]), ('="A1"&B2', [(None, 2, 2, 2, 2)]), ("=SUM(aa10:AB9)", [(None, 27, 28, 9, 10)])])
def test_references_of_a_formula(formula, boxes):
    assert whole._boxes(formula) == boxes


def test_labels_are_found_whole_as_by_joins(spark, monkeypatch):
    book, chosen = tables(spark)
    book = cut(book.unionByName(cells(spark, {"T!A1": " Net :: ", "T!B1": 1, "T!A2": ("=B1", "x"), "T!B2": 2, "T!A3": " : ", "T!B3": 3}, "labels")))
    more = outputs(spark, "T!B1", "T!B2", "T!B3", "T!B1", "T!C9", None, workbook_id="labels")
    chosen = cut(chosen.unionByName(more).unionByName(outputs(spark, "T!B1", workbook_id="gone")))
    here = C.output_labels(chosen, book)
    monkeypatch.setattr(whole, "HELD", 0)
    there = C.output_labels(chosen, book)
    assert sorted(here.columns) == sorted(there.columns)
    assert plain(here, here.columns) == plain(there, here.columns)
    assert {(r.output_ref, r.label) for r in here.filter("workbook_id = 'labels'").collect()} == {
        ("T!B1", "Net"), ("T!B2", "T!B2"), ("T!B3", "T!B3"), ("T!C9", "T!C9"), (None, None)}
