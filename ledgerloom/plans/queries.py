"""Every operator as a query over the given tables.

A query gets a session and a data folder and returns a DataFrame. Each reads its
tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions.addresses import a1
from ledgerloom.functions.amounts import delta, delta_pct, money, signed_amount, verdict
from ledgerloom.operators import cells as C
from ledgerloom.operators import detect, disclosure, events, evidence, graph, match, rebuild, report
from ledgerloom.operators import review, trace
from ledgerloom.operators.numbering import numbered
from ledgerloom.session import cut
from ledgerloom.sources import ledger, workbooks
from ledgerloom.sources.corpus import (
    order_corpus, order_heads, order_ledger, table, workbook_key,
)
from ledgerloom.sources.samples import workbook_files

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


# -- verdicts and totals -----------------------------------------------------


def _order_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored order total against the exact sum of its net lines."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (money(F.col("l_extendedprice")).cast("decimal(18,2)")
         * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).alias("net"),
    )
    sums = items.groupBy("o_orderkey").agg(F.sum("net").cast("double").alias("target_value"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").alias("source_value"),
    )
    a, b = F.col("source_value"), F.col("target_value")
    return orders.join(sums, "o_orderkey", "left").withColumns(
        {
            "delta": delta(a, b), "delta_pct": delta_pct(a, b),
            "completeness": F.when(b.isNull(), "partial").otherwise("complete"),
        }
    )


@query
def order_total_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _order_deltas(spark, sf_dir).withColumn(
        "verdict",
        verdict(F.col("delta"), F.col("delta_pct"), F.lit(0.5), F.lit(50000.0), F.col("completeness")),
    )
    return rounded(
        df.select("o_orderkey", "source_value", "target_value", "delta", "delta_pct", "verdict"),
        6, "target_value", "delta", "delta_pct",
    )


def _supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("report_id"),
        money(F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit").alias("debit_credit"),
    )


@query
def signed_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh supplier declares a total that is off by 0.01."""
    lines = _supplier_lines(spark, sf_dir)
    declared = lines.groupBy("report_id").agg(
        F.sum(signed_amount(F.col("amount"), F.col("debit_credit"))).alias("total")
    )
    extracts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id")).join(
        declared, "report_id", "left"
    ).select(
        "report_id",
        F.when(F.col("report_id") % 11 != 0, F.col("total") + F.when(
            F.col("report_id") % 7 == 0, F.lit("0.01").cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
        ).alias("control_total"),
    )
    out = review.control_totals(extracts, lines).withColumnRenamed("report_id", "suppkey")
    return rounded(out, 2, "declared_total", "signed_total", "difference")


def _priority_thresholds(orders: DataFrame) -> DataFrame:
    """Thresholds of each order: the priority sets the share, status the amount."""
    pct = F.lit(0.1) * F.left("o_orderpriority", F.lit(1)).cast("int")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("report_id"),
        F.lit("excel_vs_python").alias("check_type"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", 0.01).otherwise(pct).alias("pct_threshold"),
        F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(20000.0).alias("absolute_threshold"),
        F.when(F.col("o_orderkey") % 9 != 0, "agreed").alias("reason"),
    )


def _order_recon_lines(deltas: DataFrame) -> DataFrame:
    return deltas.select(
        F.col("o_orderkey").cast("string").alias("report_id"),
        F.lit("excel_vs_python").alias("check_type"), F.lit("Order total").alias("label"),
        "source_value", "target_value", "delta", "delta_pct", F.lit("").alias("verdict"),
        F.lit(0.01).alias("pct_threshold"), F.lit(100.0).alias("absolute_threshold"),
        F.lit(True).alias("threshold_is_default"), "completeness",
        F.lit(None).cast("string").alias("mapping_id"), F.lit(False).alias("is_final"),
    )


def _no_mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "report_id string, mapping_id string, mapping_type string, is_approved boolean"
    )


@query
def verdicts_under_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = _order_deltas(spark, sf_dir)
    lines = review.evaluate_lines(
        _order_recon_lines(deltas), _no_mappings(spark),
        _priority_thresholds(table(spark, sf_dir, "orders")), final=True,
    )
    return rounded(
        lines.select(
            "report_id", "verdict", "pct_threshold", "absolute_threshold", "threshold_is_default", "is_final"
        ), 6, "pct_threshold",
    )


@query
def unexplained_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.unexplained_thresholds(_priority_thresholds(table(spark, sf_dir, "orders")))
    return rounded(found.select("report_id", "pct_threshold", "absolute_threshold"), 6, "pct_threshold")


def _customer_contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as reports: some without an extract, some with another entity."""
    named = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey").cast("string").alias("report_id")
    contexts = named.select(
        key, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("entity"),
        F.lit("1998").alias("period"), F.lit("eur").alias("currency"),
        F.col("c_mktsegment").alias("basis"),
    )
    extracts = named.filter(F.col("c_nationkey") % 5 != 0).select(
        key, F.when(F.col("c_nationkey") % 7 == 0, F.lit("elsewhere")).otherwise(F.col("n_name")).alias("entity"),
        F.lit("1998\t").alias("period"), F.lit("EUR").alias("currency"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("basis"),
    )
    return contexts, extracts


@query
def context_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = review.compare_contexts(*_customer_contexts(spark, sf_dir))
    return compared.select(
        "report_id", "context_match", F.col("basis_warning").isNotNull().alias("basis_differs")
    )


def _customer_roll_up(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _order_deltas(spark, sf_dir).filter("target_value is not null").select(
        F.col("o_custkey").cast("string").alias("report_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "excel_vs_python").otherwise("python_vs_accounts").alias("check_type"),
        verdict(F.col("delta"), F.col("delta_pct"), F.lit(0.9), F.lit(300000.0), F.col("completeness")).alias("verdict"),
    )
    compared = review.compare_contexts(*_customer_contexts(spark, sf_dir))
    gaps = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"
    ).select(F.col("o_custkey").cast("string").alias("report_id"))
    counts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("report_id"),
        ((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < 0)).alias("has_confirmed_blocker"),
    )
    controls = spark.createDataFrame([], "report_id string, status string")
    return review.roll_up(compared, lines, gaps, gaps.limit(0), controls, counts), lines


@query
def verdict_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled, _ = _customer_roll_up(spark, sf_dir)
    acknowledged = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("report_id"),
        (F.col("c_custkey") % 2 == 0).alias("acknowledge_incomplete"),
    )
    return review.gate_status(rolled, acknowledged).select(
        "report_id", "context_match", "internal_verdict", "external_verdict", "overall_verdict", "gate_status"
    )


@query
def report_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled, lines = _customer_roll_up(spark, sf_dir)
    return review.report_flags(lines, rolled)


@query
def population_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status F against items with flag A, gaps in both directions."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.lit("all").alias("report_id"), F.col("o_orderkey").alias("line_id")
    )
    items = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(
        F.lit("all").alias("report_id"), F.col("l_orderkey").alias("output_ref")
    ).distinct()
    left = match.unmatched_lines(orders, items.withColumnRenamed("output_ref", "line_id"))
    right = match.unmapped_outputs(items, orders.withColumnRenamed("line_id", "output_ref"))
    return left.select(F.lit("order").alias("side"), F.col("line_id").alias("orderkey")).unionByName(
        right.select(F.lit("item").alias("side"), F.col("output_ref").alias("orderkey"))
    )


# -- corpus, references, graph -----------------------------------------------


@query
def corpus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_corpus(spark, sf_dir).cells
    return cells.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("formula").alias("formulas"),
        F.count_if(F.col("data_type") == "text").alias("texts"),
        F.max("row").alias("last_row"),
    )


@query
def workbook_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an .xlsx file, read back into cells."""
    files = cut(workbook_files(order_corpus(spark, sf_dir).cells))
    raw = cut(workbooks.raw_rows(files))
    names = files.select(
        F.sha2("content", 256).alias("workbook_id"), F.substring_index("path", ".", 1).alias("file")
    )
    found = workbooks.cells(raw).join(names, "workbook_id")
    return rounded(found.select("file", "node", "formula", "data_type", "value_num"), 6, "value_num")


@query
def damaged_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an .xlsx file, some cut short or overwritten: what is read of each."""
    order = F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 7
    files = cut(workbook_files(order_corpus(spark, sf_dir).cells).withColumn(
        "content",
        F.when(order == 3, F.substring("content", F.lit(1), F.length("content") - 40))
        .when(order == 5, F.encode(F.concat(F.lit("not a workbook: "), "path"), "UTF-8"))
        .otherwise(F.col("content"))))
    every = cut(workbooks.raw_rows(files))
    read = workbooks.cells(workbooks.readable(every)).groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("formula").alias("formulas"))
    none = F.lit(0).cast("bigint")
    return (
        files.select(F.sha2("content", 256).alias("workbook_id"), F.substring_index("path", ".", 1).alias("file"))
        .join(workbooks.damaged(every), "workbook_id", "left")
        .join(read, "workbook_id", "left")
        .select("file", "kind", F.coalesce("cells", none).alias("cells"), F.coalesce("formulas", none).alias("formulas"))
    )


def _event_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as raw cells of one workbook per user, with every kind of content."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 10
    raw = e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("workbook_id"),
        F.lit(0).alias("tab_index"), F.lit("Data").alias("tab_key"),
        F.concat(F.lit("A"), (F.col("event_id") + 1).cast("string")).alias("cell_ref"),
        F.lit(1).alias("col"), (F.col("event_id") + 1).cast("int").alias("row"),
        F.when(k.isin(0, 1), F.format_string("=B%d*2", F.col("event_id") + 1))
        .when(k == 2, "{=SUM(B1:B2)}").alias("raw_text"),
        (k == 2).alias("is_array"),
        F.when(k.isin(0, 9), F.lit(None).cast("string"))
        .when(k.isin(1, 2, 3), "n").when(k == 4, "b").when(k == 5, "d").otherwise("s").alias("value_kind"),
        F.when(k.isin(1, 2, 3), F.col("value")).alias("value_num"),
        F.when(k == 5, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 6, F.lit(" #DIV/0! ")).when(k == 7, F.format_string("1,%03d", F.col("event_id") % 1000))
        .when(k == 8, F.col("event_type")).alias("value_text"),
        F.when(k == 4, F.col("value") > 50).alias("value_bool"),
        F.when(k == 3, "0.00").alias("number_format"),
    )
    books = e.select(F.col("user_id")).distinct().select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("workbook_id"),
        F.when(F.col("user_id") % 3 == 0, "manual").otherwise("automatic").alias("calc_mode"),
    )
    return raw, books


@query
def cell_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build_cells(*_event_cells(spark, sf_dir)).select(
        "workbook_id", "node", "formula", "data_type", "number_format", "is_error", "error_type", "is_stale"
    )


@query
def cell_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cell_warnings(C.build_cells(*_event_cells(spark, sf_dir)))


@query
def stale_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stale_cells(C.build_cells(*_event_cells(spark, sf_dir))).select("workbook_id", "node")


@query
def tab_name_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tabs: the segment is the tab name, so names repeat; every fifth
    one differs from its likes by case or spaces."""
    c = table(spark, sf_dir, "customer")
    tabs = c.select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("workbook_id"),
        F.col("c_custkey").cast("int").alias("tab_index"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" ")))
        .otherwise(F.col("c_mktsegment")).alias("tab_name"),
    )
    return C.tab_warnings(tabs)


@query
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = graph.with_rectangle(graph.references(order_corpus(spark, sf_dir).cells))
    return refs.groupBy("workbook_id", "src").agg(
        F.count(F.lit(1)).alias("refs"), F.count("end").alias("ranges"), F.sum("area").alias("area"),
        F.count_if(F.col("dst_tab") != F.substring_index("src", "!", 1)).alias("other_tab"),
    )


@query
def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cell_edges(order_corpus(spark, sf_dir).cells)


@query
def tab_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    return C.tab_edges(c.cells, c.tabs)


@query
def output_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.candidate_outputs(order_corpus(spark, sf_dir).cells)
    return out.groupBy("workbook_id", "tab_key").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("has_formula").alias("formulas")
    )


@query
def output_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    return C.output_labels(c.outputs, c.cells).select("workbook_id", "output_ref", "label")


#: Lengths of the summed ranges; the last is longer than most tables here fill.
RANGE_LENGTHS = (4_999, 5_000, 5_001, 1_000_000)


def _plain_cells(rows: DataFrame) -> DataFrame:
    """Cells of one tab from workbook_id, col, row, formula, value_num, value_text."""
    return rows.select(
        "workbook_id", F.lit(0).alias("tab_index"), F.lit("Book").alias("tab_key"), "col", F.col("row").cast("int").alias("row"),
        "formula", F.col("value_num").cast("double").alias("value_num"), "value_text",
        F.lit(None).cast("boolean").alias("value_bool"),
        F.when(F.col("value_text").isNotNull(), "text").otherwise("number").alias("data_type"), F.lit(False).alias("is_stale"),
    ).withColumn("cell_ref", a1(F.col("col"), F.col("row"))).withColumn("node", F.concat("tab_key", F.lit("!"), "cell_ref"))


def _large_books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders in every third row of a column, a million rows a book, once for each length of
    a total over that column; half of the books hold a note between the numbers."""
    none = F.lit(None).cast("string")
    at = F.col("o_orderkey") * 3
    kinds = F.explode(F.array(*[
        F.struct(F.lit(n).alias("last"), F.lit(t).alias("note")) for n in RANGE_LENGTHS for t in (False, True)]))
    rows = table(spark, sf_dir, "orders").select(
        F.floor(at / 1_000_000).alias("part"), (at % 1_000_000 + 1).alias("row"), "o_totalprice", kinds.alias("k"))
    book = F.concat_ws("-", F.lit("orders"), F.col("part").cast("string"), F.col("k.last").cast("string"), F.when(F.col("k.note"), "note").otherwise("plain"))
    rows = rows.select(book.alias("workbook_id"), "k", "row", "o_totalprice")
    books = rows.select("workbook_id", "k.last", "k.note").distinct()
    head = books.select("workbook_id", F.inline(F.array_compact(F.array(
        F.struct(F.lit(3).alias("col"), F.lit(1).alias("row"), F.format_string("=SUM(B1:B%d)+SUM(B1:B3)", "last").alias("formula"),
                 F.lit(0.0).alias("value_num"), none.alias("value_text")),
        F.when(F.col("note"), F.struct(F.lit(2).alias("col"), F.lit(3).alias("row"), none.alias("formula"),
                                       F.lit(None).cast("double").alias("value_num"), F.lit("a note").alias("value_text")))))))
    cells = _plain_cells(rows.select(
        "workbook_id", F.lit(2).alias("col"), F.col("row").cast("int").alias("row"), none.alias("formula"),
        F.col("o_totalprice").alias("value_num"), none.alias("value_text")).unionByName(head))
    outputs = books.select(
        F.col("workbook_id").alias("report_id"), "workbook_id", F.lit(0).alias("output_pos"), F.lit("Book!C1").alias("output_ref"))
    return cells, graph.formula_edges(cells), outputs


@query
def large_range_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, edges, outputs = _large_books(spark, sf_dir)
    done = rebuild.rebuild(cut(cells), cut(edges), outputs)
    return rounded(
        done.summary.select("workbook_id", "root", "chain_nodes", "supported_nodes", "coverage_pct", "value"), 2, "value"
    )


@query
def running_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer as one running balance, rebuilt from its last cell."""
    orders = cut(numbered(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
        ["o_custkey"], [F.floor(F.col("o_orderkey") / 4096)], [F.col("o_orderkey")], "row"))
    book, row = F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")), F.col("row").cast("string")
    none = F.lit(None).cast("string")
    formula = F.when(F.col("row") == 1, F.lit("=A1")).otherwise(
        F.concat(F.lit("=B"), (F.col("row") - 1).cast("string"), F.lit("+A"), row))
    orders = orders.withColumn("workbook_id", book)
    cells = cut(_plain_cells(orders.select("workbook_id", "row", F.inline(F.array(
        F.struct(F.lit(1).alias("col"), none.alias("formula"), F.col("o_totalprice").alias("value_num"), none.alias("value_text")),
        F.struct(F.lit(2).alias("col"), formula.alias("formula"), F.lit(0.0).alias("value_num"), none.alias("value_text")))))))
    outputs = orders.groupBy("workbook_id").agg(F.max("row").alias("last")).select(
        F.col("workbook_id").alias("report_id"), "workbook_id", F.lit(0).alias("output_pos"),
        F.concat(F.lit("Book!B"), F.col("last").cast("string")).alias("output_ref"))
    done = rebuild.rebuild(cells, cut(graph.formula_edges(cells)), outputs)
    return rounded(done.summary.select("workbook_id", "root", "chain_nodes", "coverage_pct", "value"), 2, "value")


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part depends on the part with half its key."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(
        F.lit("parts").alias("workbook_id"), k.cast("string").alias("src"),
        F.floor(k / 2).cast("string").alias("dst"),
    )


@query
def part_tree_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "part").select(
        F.lit("parts").alias("workbook_id"), F.col("p_partkey").cast("string").alias("root")
    )
    return graph.reach(roots, _part_edges(spark, sf_dir)).select("root", "node", "depth")


def _supplier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation depend on the next of that nation, the last on the
    first in nations with an even key; odd nations stay open chains."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    numbers = numbered(
        s, ["s_nationkey"], [F.floor(F.col("s_suppkey") / 4096)], [F.col("s_suppkey")], "no"
    )
    nxt = numbers.select("s_nationkey", (F.col("no") - 1).alias("no"), F.col("s_suppkey").alias("dst"))
    first = numbers.filter("no = 1").select("s_nationkey", F.col("s_suppkey").alias("first"))
    return (
        numbers.join(nxt, ["s_nationkey", "no"], "left").join(first, "s_nationkey")
        .withColumn("dst", F.coalesce("dst", F.when(F.col("s_nationkey") % 2 == 0, F.col("first"))))
        .filter("dst is not null")
        .select(
            F.lit("suppliers").alias("workbook_id"), F.col("s_suppkey").cast("string").alias("src"),
            F.col("dst").cast("string").alias("dst"),
        )
    )


@query
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = graph.components(cut(_supplier_rings(spark, sf_dir)))
    return rings.select("node")


@query
def cycle_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_supplier_rings(spark, sf_dir))
    cycles = graph.elementary_cycles(edges, graph.components(edges))
    return cycles.select(
        F.col("members")[0].alias("first_member"), F.size("members").cast("bigint").alias("members")
    )


@query
def shared_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of each nation's suppliers, which form a ring with a short cut from the first to the
    third: two cycles that share their first member, in order of their sorted members."""
    suppliers = numbered(
        table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"),
        ["s_nationkey"], [F.floor(F.col("s_suppkey") / 4096)], [F.col("s_suppkey")], "no")
    sizes = suppliers.groupBy("s_nationkey").agg(F.max("no").alias("n"))
    no, n = F.col("no"), F.col("n")
    onward = F.array(F.when(no < n, no + 1).otherwise(F.lit(1)), F.when((no == 1) & (n >= 3), F.lit(3)))
    name = lambda c: F.format_string("S%07d", c)
    edges = cut(suppliers.join(sizes, "s_nationkey").withColumn("to", F.explode(F.array_distinct(F.array_compact(onward)))).select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("workbook_id"), name(no).alias("src"), name(F.col("to")).alias("dst")))
    cycles = graph.elementary_cycles(edges, graph.components(edges))
    place = F.row_number().over(Window.partitionBy("workbook_id").orderBy(F.array_sort("members")))
    return cycles.select(
        "workbook_id", place.alias("place"), F.array_join("members", " ").alias("members"),
        F.size("members").cast("bigint").alias("size"))


# -- findings ----------------------------------------------------------------


@query
def buried_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.buried_literals(order_corpus(spark, sf_dir).cells).select(
        "workbook_id", "tab_key", "cell_ref", "description"
    )


@query
def conflicting_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    return detect.conflicting_names(c.named_ranges, c.cells, c.tabs).select(
        "workbook_id", "tab_key", "cell_ref", "description"
    )


@query
def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.skipped_rows(order_corpus(spark, sf_dir).cells).select(
        "workbook_id", "tab_key", "cell_ref", "description"
    )


@query
def circular_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    # cycles run through formulas alone, so no other cell is written
    formulas = cut(graph.formula_cells(c.cells))
    edges = cut(graph.formula_edges(formulas))
    return detect.circular_references(edges, c.tabs).select("workbook_id", "tab_key", "cell_ref", "description")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, edges = _graph(spark, sf_dir)
    return detect.all_findings(c.cells, edges, c.named_ranges, c.tabs)


@query
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select(
        "workbook_id", "finding_id", "severity", "tab_key", "cell_ref", "description"
    )


@query
def finding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, edges = _graph(spark, sf_dir)
    found = detect.all_findings(c.cells, edges, c.named_ranges, c.tabs)
    return trace.finding_cells(found, c.cells, graph.cell_edges(c.cells)).select("workbook_id", "finding_id", "node", "depends_on")


def _event_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as findings of a user's report, with decisions for most of them."""
    e = table(spark, sf_dir, "events")
    key = [F.col("user_id").cast("string").alias("report_id"), F.col("event_id").cast("string").alias("finding_id")]
    severity = F.when(F.col("event_type") == "error", "blocker").when(
        F.col("event_type") == "purchase", "info").otherwise("warning")
    findings = e.select(*key, F.col("event_id").alias("finding_no"), severity.alias("severity"))
    k = F.col("event_id")
    decisions = e.filter(k % 13 != 0).select(
        *key,
        F.when(k % 3 == 0, "overridden").when(k % 3 == 1, "dismissed").otherwise("confirmed").alias("decision"),
        F.when(k % 4 == 0, " ").when(k % 4 == 1, "seen").alias("reason"),
        F.lit("Reviewer A").alias("decided_by"),
    )
    return findings, decisions


@query
def undecided_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.undecided_findings(*_event_findings(spark, sf_dir))


@query
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.finding_counts(*_event_findings(spark, sf_dir))


# -- rebuild and reconciliation ----------------------------------------------


def _stored(c):
    c.cells = cut(c.cells)
    return c


def _graph(spark: SparkSession, sf_dir: str):
    """The corpus with its cell table and formula edges written once, as later steps
    read them several times."""
    c = _stored(order_corpus(spark, sf_dir))
    return c, cut(graph.formula_edges(c.cells))


def _rebuilt(spark: SparkSession, sf_dir: str):
    c, edges = _graph(spark, sf_dir)
    c.outputs = cut(c.outputs)  # read by the rebuild, the lines and the reports
    return c, edges, rebuild.rebuild(c.cells, edges, c.outputs)


@query
def derivation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = _rebuilt(spark, sf_dir)
    return rounded(
        done.summary.select("workbook_id", "root", "chain_nodes", "supported_nodes", "coverage_pct", "value"),
        6, "coverage_pct", "value",
    )


@query
def derivation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = _rebuilt(spark, sf_dir)
    steps = rebuild.derivations(done)
    return steps.groupBy("workbook_id", "root_ref").agg(
        F.max("depth").alias("depth"), F.count("formula").alias("formulas"),
        F.sum("depends_on").alias("depends_on"), F.count("reason").alias("unsupported"),
    )


@query
def internal_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, done = _rebuilt(spark, sf_dir)
    lines = rebuild.internal_lines(c.outputs, c.cells, done)
    return rounded(
        lines.select(
            "report_id", "output_ref", "label", "source_value", "target_value", "delta", "verdict",
            "completeness", "coverage_pct", "unsupported_count",
        ), 6, "source_value", "target_value", "delta", "coverage_pct",
    )


@query
def unreconstructed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of an order's incomplete outputs that was not rebuilt.

    Shares have six places, so means of them can end on half a unit; four are shown.
    """
    c, _, done = _rebuilt(spark, sf_dir)
    return rounded(report.unreconstructed_pct(rebuild.internal_lines(c.outputs, c.cells, done)), 4, "incomplete_pct")


@query
def cells_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every order's tabs with its place by reference as text."""
    return C.by_reference(order_corpus(spark, sf_dir).cells).select("workbook_id", "tab_key", "cell_ref", "position")


def _labelled(c) -> DataFrame:
    return C.output_labels(c.outputs, c.cells).select("report_id", "output_pos", "output_ref", "label")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger lines, written once, as matching and review read them several times."""
    return cut(order_ledger(spark, sf_dir))


@query
def label_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    mappings, _ = match.propose(_ledger(spark, sf_dir), cut(_labelled(c)))
    return mappings.select(
        "report_id", "mapping_id", "output_ref", "line_id", "mapping_type", "suggested_confidence", "is_approved"
    )


@query
def part_label_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of a brand as outputs; the words in reverse order as ledger lines."""
    p = table(spark, sf_dir, "part")
    outputs = p.select(
        F.col("p_brand").alias("report_id"), F.col("p_partkey").cast("int").alias("output_pos"),
        F.concat(F.lit("Parts!B"), F.col("p_partkey").cast("string")).alias("output_ref"),
        F.col("p_name").alias("label"),
    )
    lines = numbered(
        p.select(
            F.col("p_brand").alias("report_id"), "p_partkey",
            F.concat(
                F.initcap(F.substring_index("p_name", " ", -1)), F.lit(", "), F.substring_index("p_name", " ", 1)
            ).alias("label"),
        ),
        ["report_id"], [F.floor(F.col("p_partkey") / 4096)], [F.col("p_partkey")], "line_no",
    ).withColumn("line_id", F.format_string("REF-%04d", "line_no"))
    mappings, _ = match.propose(lines, outputs)
    return mappings.select("report_id", "mapping_id", "output_ref", "line_id", "mapping_type", "suggested_confidence")


def _reconciled(spark: SparkSession, sf_dir: str):
    c, edges, done = _rebuilt(spark, sf_dir)
    internal = cut(rebuild.internal_lines(c.outputs, c.cells, done))
    lines = _ledger(spark, sf_dir)
    mappings, held = match.propose(
        lines, internal.select("report_id", "output_pos", "output_ref", "label")
    )
    both = cut(match.both_passes(internal, match.external_lines(mappings, internal, lines)))
    return c, lines, mappings, held, both


@query
def external_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, both = _reconciled(spark, sf_dir)
    return rounded(
        report.pass_lines(both, "python_vs_accounts").select(
            "report_id", "mapping_id", "label", "source_value", "target_value", "delta", "verdict", "completeness"
        ), 6, "source_value", "target_value", "delta",
    )


@query
def unmatched_ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    lines = _ledger(spark, sf_dir)
    mappings, held = match.propose(lines, cut(_labelled(c)))
    left = match.unmatched_lines(lines, mappings).select("report_id", F.col("line_id").alias("item"))
    right = match.unmapped_outputs(c.outputs, held).select("report_id", F.col("output_ref").alias("item"))
    return left.unionByName(right)


def _decisions(mappings: DataFrame) -> DataFrame:
    """Decisions by report number: approve, reject or move to the third line."""
    k = F.substring("report_id", 4, 20).cast("bigint")
    return mappings.select(
        "report_id", "mapping_id",
        F.when(k % 4 == 0, "edit").when(k % 4 == 1, "reject").otherwise("approve").alias("action"),
        F.when((k % 4 == 0) & (F.col("mapping_id") == "MAP-0001"), "REF-0003").when(
            k % 4 == 0, "REF-0001"
        ).alias("replacement_line_id"),
        F.lit("Reviewer A").alias("actor"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("decided_at"),
    )


def _reviewed(spark: SparkSession, sf_dir: str):
    c, lines, mappings, _, both = _reconciled(spark, sf_dir)
    after, kept = review.apply_reviews(mappings, both, _decisions(mappings), lines)
    thresholds = spark.createDataFrame(
        [], "report_id string, check_type string, pct_threshold double, absolute_threshold double"
    )
    after = cut(after)
    return c, lines, after, cut(review.evaluate_lines(kept, after, thresholds, final=True))


@query
def reviewed_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, after, _ = _reviewed(spark, sf_dir)
    return after.select(
        "report_id", "mapping_id", "line_id", "output_ref", "suggested_by", "approved_by", "is_approved"
    )


@query
def reviewed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, final = _reviewed(spark, sf_dir)
    return rounded(
        final.filter("check_type = 'python_vs_accounts'").select(
            "report_id", "mapping_id", "label", "target_value", "delta", "verdict", "is_final"
        ), 6, "target_value", "delta",
    )


@query
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lines, after, kept = _reviewed(spark, sf_dir)
    unmatched, unmapped = review.population_gaps(after, lines, c.outputs)
    reports = c.outputs.select("report_id").distinct()
    context = reports.select("report_id", F.lit("Acme").alias("entity"), F.lit("1998").alias("period"),
                             F.lit("EUR").alias("currency"), F.lit(None).cast("string").alias("basis"))
    compared = review.compare_contexts(context, context)
    counts = reports.withColumns({"findings": F.lit(0), "has_confirmed_blocker": F.lit(False)})
    rolled = review.roll_up(
        compared, kept, unmatched, unmapped,
        spark.createDataFrame([], "report_id string, status string"), counts,
    )
    return report.report_summary(reports, rolled, counts, kept, after).select(
        "report_id", "gaps", "internal_verdict", "external_verdict", "overall_verdict",
        "internal_lines", "external_lines", "mappings", "approved_mappings",
    )


@query
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines, after, kept = _reviewed(spark, sf_dir)
    extracts = lines.select("report_id", F.lit("general ledger").alias("source_label")).distinct()
    rows = report.mapping_report(after, kept, lines, extracts)
    return rounded(
        rows.select(
            "report_id", "mapping_id", "label", "account_number", "accounts_value", "verdict",
            "source_label", "is_approved",
        ), 6, "accounts_value",
    )


@query
def mapping_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping report split as a reader sees it: approved, proposed, manual."""
    _, lines, after, kept = _reviewed(spark, sf_dir)
    extracts = lines.select("report_id", F.lit("general ledger").alias("source_label")).distinct()
    # reports of every seventh order have a first mapping that takes several lines
    many = (F.regexp_extract("report_id", r"(\d+)", 1).cast("bigint") % 7 == 0) & F.startswith("mapping_id", F.lit("MAP-0001"))
    after = after.withColumn("mapping_type", F.when(many, "one_to_many").otherwise(F.col("mapping_type")))
    parts = report.mapping_sections(report.mapping_report(after, kept, lines, extracts))
    approved, proposed, manual = (
        part.select("report_id", F.lit(name).alias("section"), "mapping_id", "account_number")
        for name, part in zip(("approved", "proposed", "manual"), parts))
    return approved.unionByName(proposed).unionByName(manual)


@query
def trace_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lines, after, kept = _reviewed(spark, sf_dir)
    unmatched, _ = review.population_gaps(after, lines, c.outputs)
    found = detect.skipped_rows(c.cells).select(
        F.col("workbook_id").alias("report_id"), F.lit("F0001").alias("finding_id"), "tab_key",
        "cell_ref", "description",
    )
    index = trace.trace_index(kept, after, lines, unmatched, found)
    return rounded(
        index.select(
            "report_id", "section", "figure_key", "report_value", "root_ref", "trace_status",
            F.col("provenance.account_number").alias("account_number"),
        ), 6, "report_value",
    )


def _review_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as mappings of their customer, events as decisions on them."""
    orders = table(spark, sf_dir, "orders")
    mappings = orders.select(
        (F.col("o_custkey") % 100).cast("string").alias("report_id"),
        F.col("o_orderkey").cast("string").alias("mapping_id"),
        F.when(F.col("o_orderstatus") == "P", "one_to_many").otherwise("one_to_one").alias("mapping_type"),
        (F.col("o_orderkey") % 50).cast("string").alias("line_id"),
        F.lit("Lines!B2").alias("output_ref"),
    )
    e = table(spark, sf_dir, "events").join(
        mappings.select("report_id", "mapping_id"),
        F.col("event_id").cast("string") == F.col("mapping_id"), "left",
    )
    action = (
        F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "reject")
        .when(F.col("event_type") == "error", "acknowledge_manual").otherwise("edit")
    )
    one = e.select(
        F.coalesce("report_id", F.lit("none")).alias("report_id"),
        F.coalesce("mapping_id", F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("mapping_id"),
        action.alias("action"),
        F.when((action == "edit") & (F.col("event_id") % 6 != 0), (F.col("event_id") % 60).cast("string")).alias("replacement_line_id"),
        F.lit("Reviewer A").alias("actor"), F.col("event_id"),
    )
    decisions = one.unionByName(one.filter("event_id % 500 = 0")).drop("event_id")
    lines = mappings.select("report_id").distinct().withColumn(
        "line_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: i.cast("string")))
    )
    return mappings, decisions, lines


@query
def review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_errors(*_review_cases(spark, sf_dir)).groupBy("problem").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("mapping_id").alias("mappings")
    )


@query
def unreviewed_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings, decisions, _ = _review_cases(spark, sf_dir)
    return review.unreviewed_mappings(mappings, decisions)


@query
def mapping_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as second-pass lines; items decide whether the mapping is approved."""
    orders = table(spark, sf_dir, "orders")
    lines = orders.select(
        (F.col("o_custkey")).cast("string").alias("report_id"), F.col("o_orderkey").cast("string").alias("label"),
        F.lit("python_vs_accounts").alias("check_type"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey").cast("string")).alias("mapping_id"),
    )
    mappings = orders.filter("o_orderkey % 7 != 0").select(
        (F.col("o_custkey")).cast("string").alias("report_id"), F.col("o_orderkey").cast("string").alias("mapping_id"),
        (F.col("o_orderstatus") == "F").alias("is_approved"),
    )
    return review.mapping_violations(lines, mappings)


@query
def output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders designate the row after their last item; those without items none."""
    c = order_corpus(spark, sf_dir)
    reports = table(spark, sf_dir, "orders").select(workbook_key(F.col("o_orderkey")).alias("report_id"))
    wrong = order_heads(spark, sf_dir).filter("orderkey % 8 = 0").select(
        workbook_key(F.col("orderkey")).alias("report_id"), workbook_key(F.col("orderkey")).alias("workbook_id"),
        F.format_string("Lines!E%d", "n").alias("output_ref"),
    )
    outputs = c.outputs.select("report_id", "workbook_id", "output_ref").unionByName(wrong)
    return review.output_errors(reports, outputs, c.cells)


# -- ledger extracts ---------------------------------------------------------


def _ledger_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as text rows of a ledger file per customer, some of them bad or blank."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("report_id"), (k + 1).alias("row_no"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("-account"))).alias("account_number"),
        F.when(k % 17 == 0, F.lit(" ")).when(k % 23 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("label"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 29 == 0, F.lit("-5")).when(k % 31 == 0, F.lit("n.a.")).when(
            k % 37 == 0, F.lit("inf")).when(k % 41 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(k % 17 == 0, F.lit("")).when(k % 43 == 0, F.lit("both")).when(k % 2 == 0, F.lit("Debit ")).otherwise(F.lit("CREDIT")).alias("debit_credit"),
    )
    c = table(spark, sf_dir, "customer")
    extracts = c.select(
        F.col("c_custkey").cast("string").alias("report_id"),
        F.when(F.col("c_custkey") % 50 != 0, F.lit("ledger")).alias("source_label"),
        F.col("c_name").alias("entity"), F.lit(" 1998 ").alias("period"), F.lit("eur").alias("currency"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).cast("decimal(38,12)").alias("control_total"),
        (F.col("c_custkey") % 20 == 0).alias("control_total_confirmed"),
    )
    return rows, extracts


@query
def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = ledger.ledger_lines(*_ledger_rows(spark, sf_dir))
    return rounded(
        lines.select("report_id", "line_id", "account_number", "label", "currency", "ledger_source", "debit_credit", "amount"),
        2, "amount",
    )


@query
def ledger_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors = ledger.ledger_lines(*_ledger_rows(spark, sf_dir))
    return errors


@query
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, extracts = _ledger_rows(spark, sf_dir)
    lines, _ = ledger.ledger_lines(rows, extracts)
    return ledger.extract_errors(extracts, lines)


@query
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; some confirmed hashes are wrong or malformed."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("report_id")
    right = F.sha2(F.col("text").cast("binary"), 256)
    contexts = docs.select(
        key, F.col("source").alias("filename"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("0" * 64))
        .when(F.col("doc_id") % 10 == 1, F.concat(right, F.lit("\n")))
        .otherwise(right).alias("confirmed_hash"),
    )
    files = docs.select(key, F.col("text").cast("binary").alias("content"))
    return review.file_identity(files, contexts)


# -- disclosure --------------------------------------------------------------


def _document_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as cells: language is the workbook, source the tab. A cell holds the
    whole text, a label, a flag, or a formula into another file."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    cells = docs.select(
        F.col("lang").alias("workbook_id"), F.col("source").alias("tab_key"),
        F.concat(F.col("source"), F.lit("!A"), (k + 1).cast("string")).alias("node"),
        F.when(k % 9 == 0, F.lit("='[Other.XLSX]Sheet1'!A1")).alias("formula"),
        F.when(k % 9 == 0, F.col("n_chars").cast("double")).alias("value_num"),
        F.when((k % 9 != 0) & (k % 4 == 1), F.col("source")).when(
            (k % 9 != 0) & (k % 4 != 3), F.col("text")).alias("value_text"),
        F.when((k % 9 != 0) & (k % 4 == 3), k % 8 == 3).alias("value_bool"),
        F.when(k % 9 == 0, "number").when(k % 4 == 3, "boolean").otherwise("text").alias("data_type"),
        F.lit(False).alias("is_stale"),
    )
    requests = docs.select(F.col("lang").alias("workbook_id"), F.col("source").alias("tab_key")).distinct()
    edges = spark.createDataFrame([], "workbook_id string, src string, dst string")
    return cells, requests, edges


@query
def disclosure_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, requests, edges = _document_cells(spark, sf_dir)
    outputs = spark.createDataFrame([], "workbook_id string, output_ref string")
    scope = disclosure.cells_in_scope(requests, cells, edges, outputs)
    return disclosure.decide(requests, cells, scope)


@query
def disclosure_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, requests, edges = _document_cells(spark, sf_dir)
    outputs = spark.createDataFrame([], "workbook_id string, output_ref string")
    names = spark.createDataFrame([], "workbook_id string, scope string, name string, definition string")
    scope = disclosure.cells_in_scope(requests, cells, edges, outputs)
    return disclosure.manifest(requests, cells, scope, outputs, names).drop("payload_chars")


@query
def workbook_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the Summary and Rates tabs of every order workbook."""
    c = _stored(order_corpus(spark, sf_dir))
    edges = cut(graph.cell_edges(c.cells))
    requests = c.tabs.filter("tab_key != 'Lines'").select("workbook_id", "tab_key")
    scope = disclosure.cells_in_scope(requests, c.cells, edges, c.outputs)
    found = disclosure.manifest(requests, c.cells, scope, c.outputs, c.named_ranges)
    return found.select("workbook_id", "tab_key", "included", "excluded", "out_of_scope")


@query
def names_for_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_corpus(spark, sf_dir)
    requests = c.tabs.select("workbook_id", "tab_key")
    return disclosure.names_for_tabs(requests, c.named_ranges)


# -- log and snapshots -------------------------------------------------------


def _event_log_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log events of the user's report."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("report_id"), k.alias("event_no"),
        F.when(F.col("event_type") == "purchase", "state_snapshot").otherwise("gate_decision").alias("event_type"),
        F.concat(
            F.lit('{"action":"'), F.col("event_type"), F.lit('","gate":'), (k % 4 + 1).cast("string"),
            F.when(k % 4 == 2, F.when(k % 8 == 2, ',"acknowledge_incomplete":true').otherwise(',"acknowledge_incomplete":false')).otherwise(""),
            F.lit("}"),
        ).alias("payload_json"),
        F.concat(F.lit("t"), k.cast("string")).alias("ts"),
        F.when(k % 5 != 0, F.concat(F.lit("Reviewer "), (k % 3).cast("string"))).alias("actor"),
    )


@query
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = evidence.append_events(_event_log_input(spark, sf_dir), keys=["report_id"])
    return log.select("report_id", "row_id", "payload_hash", "prev_row_hash", "row_hash")


@query
def log_append_single_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = evidence.append_events(_event_log_input(spark, sf_dir))
    return log.select("row_id", "prev_row_hash", "row_hash")


def _damaged(log: DataFrame) -> DataFrame:
    edited = F.when(F.col("row_id") % 97 == 0, F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json"))
    return cut(log.filter("row_id % 101 != 0").withColumn("payload_json", edited))


@query
def log_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _damaged(evidence.append_events(_event_log_input(spark, sf_dir), keys=["report_id"]))
    return evidence.broken_rows(log, ["report_id"])


@query
def single_chain_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.broken_rows(_damaged(evidence.append_events(_event_log_input(spark, sf_dir))))


@query
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log_input(spark, sf_dir).select(
        "report_id", F.col("event_no").alias("row_id"), "event_type",
        F.when(F.col("event_no") % 50 == 0, F.lit("not json")).otherwise(F.col("payload_json")).alias("payload_json"),
        "ts", "actor", F.sha2("payload_json", 256).alias("row_hash"),
    )
    return report.audit_events(log)


@query
def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log_input(spark, sf_dir).withColumnRenamed("event_no", "row_id")
    return report.acknowledgements(log)


@query
def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_no")
    batch = _event_log_input(spark, sf_dir).withColumns(
        {
            "workbook_hash": F.when(k % 11 != 0, F.lit("not_yet_parsed")),
            "code_version": F.when(k % 13 == 0, F.lit("")).otherwise(F.lit("v1")),
            "payload_json": F.when(k % 7 == 0, F.lit('{"context":null}')).otherwise(F.col("payload_json")),
        }
    )
    return evidence.event_errors(batch).select("report_id", F.col("event_no").alias("row_id"), "problem")


@query
def independence_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log_input(spark, sf_dir).withColumnRenamed("event_no", "row_id")
    log = log.withColumn("actor", F.expr("if(report_id % 3 = 0 and actor = 'Reviewer 0', null, actor)"))
    approvals = log.select("report_id").distinct().select(
        "report_id",
        F.when(F.col("report_id").cast("int") % 2 == 0, " reviewer 1").otherwise("Reviewer B").alias("approval_name"),
        F.lit("partner").alias("role"),
    )
    approvers = spark.createDataFrame([("REVIEWER 1 ",)], "name string")
    judged = events.registered(approvals, approvers)
    return events.independence(judged, log).select("report_id", "name_in_registry", "preparers", "same_person")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.snapshot_rows(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("snapshot_id"), F.col("user_id").cast("string").alias("report_id"),
            F.col("event_type").alias("gate_name"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("captured_at"),
            F.col("props").alias("state_json"),
        )
    )


@query
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest_snapshots(_states(spark, sf_dir), ["report_id", "gate_name"]).select(
        "report_id", "gate_name", "snapshot_id", "state_hash"
    )


@query
def recovery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots committed to a log; some commitments are missing, some states and
    some log rows were changed afterwards."""
    states = _states(spark, sf_dir)
    entries = evidence.snapshot_events(states.filter("snapshot_id % 6 != 0")).select(
        "report_id", F.col("snapshot_id").alias("event_no"), "event_type", "payload_json", "ts",
        F.lit("Reviewer A").alias("actor"),
    )
    log = evidence.append_events(entries, keys=["report_id"])
    log = cut(
        log.withColumn(
            "ts", F.when((F.col("report_id").cast("int") % 10 == 0) & (F.col("row_id") % 25 == 1), "changed").otherwise(F.col("ts"))
        )
    )
    changed = states.withColumn(
        "state_json", F.when(F.col("snapshot_id") % 4 == 1, F.concat("state_json", F.lit(" "))).otherwise(F.col("state_json"))
    )
    latest = evidence.latest_snapshots(changed, ["report_id"])
    return evidence.recovery_status(latest, log, ["report_id"])


@query
def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, finding, mapping and approval events of customers, orders and users."""
    contexts, extracts = _customer_contexts(spark, sf_dir)
    compared = review.compare_contexts(contexts, extracts)
    named = contexts.select("report_id", F.lit("book.xlsx").alias("filename"), F.col("basis").alias("description"),
                            F.lit("Reviewer A").alias("actor"))
    controls = spark.createDataFrame(
        [], "report_id string, status string, declared_total double, signed_total double, difference double"
    )
    one = events.context_events(named, compared, controls)
    findings, decisions = _event_findings(spark, sf_dir)
    actors = findings.select("report_id").distinct().withColumn("actor", F.lit("Reviewer A"))
    two = events.disposition_events(findings, decisions, actors)
    mappings, ruled, _ = _review_cases(spark, sf_dir)
    three = events.mapping_events(mappings, ruled.distinct())
    field = lambda n: F.get_json_object("payload_json", f"$.{n}")
    return (
        one.unionByName(two).unionByName(three)
        .groupBy("event_type", F.coalesce(field("gate"), F.lit("-")).alias("gate"),
                 F.coalesce(field("action"), F.lit("-")).alias("action"),
                 F.coalesce(field("context_match_verdict"), F.lit("-")).alias("context_match"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("report_id").alias("reports"))
    )
