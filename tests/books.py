"""Small cell tables for tests."""

from pyspark.sql import functions as F

from ledgerloom.functions.addresses import ref_col, ref_row

CELLS = (
    "workbook_id string, tab_index int, tab_key string, cell_ref string, formula string, "
    "value_num double, value_text string, value_bool boolean, data_type string"
)


def cells(spark, book: dict, workbook_id: str = "w"):
    """``book``: {"Tab!A1": value or formula or (formula, stored value)}."""
    tabs = list(dict.fromkeys(k.split("!")[0] for k in book))
    rows = []
    for node, content in book.items():
        tab, ref = node.split("!")
        formula, value = content if isinstance(content, tuple) else (None, content)
        if isinstance(value, str) and value.startswith("=") and formula is None:
            formula, value = value, None
        kind = (
            "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float))
            else "text" if isinstance(value, str) else "blank"
        )
        rows.append(
            (
                workbook_id, tabs.index(tab), tab, ref, formula,
                float(value) if kind == "number" else None,
                value if kind == "text" else None,
                value if kind == "boolean" else None, kind,
            )
        )
    df = spark.createDataFrame(rows, CELLS)
    return df.withColumns(
        {
            "node": F.concat("tab_key", F.lit("!"), "cell_ref"),
            "col": ref_col(F.col("cell_ref")), "row": ref_row(F.col("cell_ref")),
            "number_format": F.lit("General"), "is_error": F.lit(False),
            "error_type": F.lit(None).cast("string"),
            "is_stale": F.col("formula").isNotNull() & (F.col("data_type") == "blank"),
            "is_array": F.lit(False),
        }
    )


def outputs(spark, *refs, workbook_id="w"):
    return spark.createDataFrame(
        [("r", workbook_id, i, ref) for i, ref in enumerate(refs)],
        "report_id string, workbook_id string, output_pos int, output_ref string",
    )


def tabs(spark, *names, workbook_id="w"):
    return spark.createDataFrame(
        [(workbook_id, i, n, n) for i, n in enumerate(names)],
        "workbook_id string, tab_index int, tab_name string, tab_key string",
    )
