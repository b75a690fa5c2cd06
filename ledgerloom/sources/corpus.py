"""A workbook corpus derived from order data: one order is one workbook.

Three tabs per order. ``Lines`` lists the items (label, price, discount, net
formula) and a total; ``Summary`` applies a factor to the total; ``Rates`` holds
the factors. Flags in the data decide which workbooks carry a buried constant, a
skipped row, an unsupported function, a cycle or conflicting named values, so
every check has workbooks with and without something to find.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions.addresses import a1


@dataclass
class Corpus:
    cells: DataFrame
    tabs: DataFrame
    named_ranges: DataFrame
    outputs: DataFrame
    workbooks: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their row number in the workbook of their order.

    An order is bounded by its item count, so the window sorts short groups.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_discount", "l_returnflag",
    )
    position = F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag"
        )
    )
    return items.select(
        F.col("l_orderkey").alias("orderkey"), position.alias("rn"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("item"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    ).repartition("orderkey").join(counts, "orderkey")


def workbook_key(orderkey: Column) -> Column:
    return F.concat(F.lit("wb-"), orderkey.cast("string"))


def _text(*parts) -> Column:
    """Parts put together as text; columns become their decimal text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _cell(tab: int, col: int, row: Column, formula=None, num=None, text=None) -> Column:
    as_text = lambda v: F.lit(v).cast("string") if not isinstance(v, Column) else v
    return F.struct(
        F.lit(tab).alias("tab_index"),
        F.lit(col).alias("col"),
        row.cast("int").alias("row"),
        as_text(formula).alias("formula"),
        (F.lit(num).cast("double") if not isinstance(num, Column) else num.cast("double")).alias("value_num"),
        as_text(text).alias("value_text"),
    )


def order_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    rows, heads = order_rows(spark, sf_dir), order_heads(spark, sf_dir)
    rn = F.col("rn")
    net = F.when(F.col("returned"), _text("=B", rn, "*0.95")).otherwise(
        _text("=B", rn, "*(1-C", rn, ")")
    )
    net_value = F.when(F.col("returned"), F.col("price") * 0.95).otherwise(
        F.col("price") * (1 - F.col("discount"))
    )
    line_cells = rows.select(
        "orderkey",
        F.explode(
            F.array(
                _cell(0, 1, rn, text=F.col("item")),
                _cell(0, 2, rn, num=F.col("price")),
                _cell(0, 3, rn, num=F.col("discount")),
                _cell(0, 4, rn, formula=net, num=net_value),
            )
        ).alias("c"),
    )
    n, below = F.col("n"), F.col("n") + 1
    total = (
        F.when(F.col("priority") == "5-LOW", _text("=VLOOKUP(A1,A1:D", n, ",4)"))
        .when(
            (F.col("priority") == "1-URGENT") & (n >= 3),
            _text("=SUM(D1:D1,D3:D", n, ")"),
        )
        .otherwise(_text("=SUM(D1:D", n, ")"))
    )
    one = F.lit(1)
    head_cells = heads.select(
        "orderkey",
        F.explode(
            F.array_compact(
                F.array(
                    _cell(0, 1, below, text="Order total:"),
                    _cell(0, 2, below, formula=total, num=F.col("total")),
                    _cell(1, 1, one, text="Net of charge:"),
                    _cell(1, 2, one, formula=_text("=Lines!B", below, "*Rates!A1"), num=F.col("total") * 1.1),
                    F.when(F.col("status") == "P", _cell(1, 3, one, formula="=Summary!D1+1", num=0.0)),
                    F.when(F.col("status") == "P", _cell(1, 4, one, formula="=C1-1", num=0.0)),
                    _cell(2, 1, one, num=1.1),
                    _cell(2, 1, F.lit(2), num=F.when(F.col("orderkey") % 3 == 0, 1.2).otherwise(1.1)),
                )
            )
        ).alias("c"),
    )
    names = F.array(F.lit("Lines"), F.lit("Summary"), F.lit("Rates"))
    flat = line_cells.unionByName(head_cells).select("orderkey", "c.*")
    cells = flat.select(
        workbook_key(F.col("orderkey")).alias("workbook_id"),
        "tab_index",
        F.element_at(names, F.col("tab_index") + 1).alias("tab_key"),
        a1(F.col("col"), F.col("row")).alias("cell_ref"),
        "col", "row", "formula", "value_num", "value_text",
        F.lit(None).cast("boolean").alias("value_bool"),
        F.when(F.col("value_num").isNotNull(), "number").otherwise("text").alias("data_type"),
        F.lit("General").alias("number_format"),
        F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("error_type"),
        F.lit(False).alias("is_stale"), F.lit(False).alias("is_array"),
    ).withColumn("node", F.concat("tab_key", F.lit("!"), "cell_ref"))
    ids = heads.select(workbook_key(F.col("orderkey")).alias("workbook_id"), "n")
    tabs = ids.select(
        "workbook_id", F.posexplode(names).alias("tab_index", "tab_name")
    ).withColumn("tab_key", F.col("tab_name"))
    named = ids.select(
        "workbook_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(scope).alias("scope"), F.lit(name).alias("name"),
                        F.lit(definition).alias("definition"),
                    )
                    for scope, name, definition in (
                        ("Lines", "rate", "Rates!$A$1"),
                        ("Summary", "rate", "Rates!$A$2"),
                        ("workbook", "first_item", "Lines!$A$1"),
                    )
                ]
            )
        ),
    )
    outputs = ids.select(
        F.col("workbook_id").alias("report_id"), "workbook_id",
        F.posexplode(
            F.array(_text("Lines!B", F.col("n") + 1), F.lit("Summary!B1"))
        ).alias("output_pos", "output_ref"),
    )
    workbooks = ids.select("workbook_id", F.lit("automatic").alias("calc_mode"))
    return Corpus(cells, tabs, named, outputs, workbooks)


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines of every order workbook: a near label for each of its two outputs,
    sometimes a repeated label, sometimes a line without counterpart."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    net = F.when(F.col("returned"), money("price") * F.lit("0.95").cast("decimal(4,2)")).otherwise(
        money("price") * (F.lit(1).cast("decimal(4,2)") - F.col("discount").cast("decimal(4,2)"))
    )
    sums = order_rows(spark, sf_dir).groupBy("orderkey").agg(
        F.round(F.sum(net), 2).cast("decimal(38,12)").alias("net")
    )
    k = F.col("orderkey")

    def line(no: int, label: str, side: str, amount: Column, account: str) -> Column:
        return F.struct(
            F.lit(no).alias("line_no"), F.lit(f"REF-{no:04d}").alias("line_id"),
            F.lit(label).alias("label"), F.lit(side).alias("debit_credit"),
            amount.cast("decimal(38,12)").alias("amount"), F.lit(account).alias("account_number"),
        )

    lines = F.array_compact(
        F.array(
            line(1, "Order totals", "debit", F.col("net") + F.when(k % 5 == 0, 50).otherwise(0), "4000"),
            line(2, "Net of charges", "debit", F.round(money("total") * F.lit("1.1").cast("decimal(4,2)"), 2), "4100"),
            F.when(k % 4 == 0, line(3, "Freight insurance", "credit", F.lit(25), "4200")),
            F.when(k % 6 == 0, line(4, "Order total", "debit", F.col("net"), "4300")),
        )
    )
    return order_heads(spark, sf_dir).join(sums, "orderkey").select(
        workbook_key(k).alias("report_id"), F.inline(lines)
    ).select(
        "*", F.lit("Acme").alias("entity"), F.lit("1998").alias("period"), F.lit("EUR").alias("currency"),
        F.lit("Not supplied").alias("ledger_source"), F.lit(None).cast("string").alias("evidence_ref"),
    )
