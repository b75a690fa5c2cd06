"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.amounts import signed_amount

BUCKETS = 256


def mapping_report(
    mappings: DataFrame, recon_lines: DataFrame, lines: DataFrame, extracts: DataFrame
) -> DataFrame:
    """Each mapping with its compared values, or the ledger amount where none exist."""
    compared = recon_lines.filter(
        "check_type = 'python_vs_accounts' and mapping_id is not null"
    ).select(
        "report_id", "mapping_id", F.col("label").alias("_label"),
        F.col("source_value").alias("python_value"), "target_value", "delta", "delta_pct",
        F.col("verdict").alias("_verdict"),
    )
    ledger = lines.select(
        "report_id", "line_id", "account_number",
        signed_amount(F.col("amount"), F.col("debit_credit")).cast("double").alias("_signed"),
    )
    has_line = F.col("_verdict").isNotNull()
    return (
        mappings.join(compared, ["report_id", "mapping_id"], "left")
        .join(ledger, ["report_id", "line_id"], "left")
        .join(extracts.select("report_id", "source_label"), "report_id", "left")
        .select(
            "report_id", "mapping_id", F.coalesce("_label", "output_ref").alias("label"),
            "account_number", "python_value",
            F.when(has_line, F.col("target_value")).otherwise(F.col("_signed")).alias("accounts_value"),
            "delta", "delta_pct", F.coalesce("_verdict", F.lit("incomplete")).alias("verdict"),
            "approved_by", "is_approved", "source_label", "suggested_confidence", "mapping_type",
            "approval_note", "output_ref", "line_id",
        )
    )


def mapping_sections(report: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(approved, proposed, manual) rows of the mapping report."""
    return (
        report.filter("is_approved"),
        report.filter("not is_approved"),
        report.filter("mapping_type != 'one_to_one'"),
    )


def pass_lines(recon_lines: DataFrame, check_type: str) -> DataFrame:
    return recon_lines.filter(F.col("check_type") == check_type)


def audit_events(log: DataFrame) -> DataFrame:
    """Readable projection of log rows; bad payloads give dashes."""
    field = lambda name: F.get_json_object("payload_json", f"$.{name}")
    given = lambda c: F.nullif(c, F.lit(""))
    return log.select(
        "report_id", "row_id", "event_type",
        F.coalesce(field("gate"), F.lit("-")).alias("gate"),
        F.coalesce(given(field("action")), given(field("outcome")), F.lit("-")).alias("action"),
        F.coalesce(given(F.col("actor")), F.lit("-")).alias("actor"),
        F.coalesce(given(F.col("ts")), F.lit("-")).alias("ts"),
        F.substring(F.coalesce("row_hash", F.lit("")), 1, 12).alias("short_hash"),
    )


def acknowledgements(log: DataFrame) -> DataFrame:
    """Acknowledgement of incompleteness in the last third-gate event of a report."""
    given = F.get_json_object("payload_json", "$.acknowledge_incomplete")
    return (
        log.filter((F.get_json_object("payload_json", "$.gate") == "3") & given.isNotNull())
        .groupBy("report_id")
        .agg((F.max_by(given, "row_id") == "true").alias("acknowledge_incomplete"))
    )


def unreconstructed_pct(internal: DataFrame) -> DataFrame:
    """Mean share not rebuilt over a report's incomplete lines."""
    return (
        internal.filter("verdict = 'incomplete' or completeness = 'partial'")
        .groupBy("report_id")
        .agg(F.avg(100.0 - F.col("coverage_pct")).alias("incomplete_pct"))
    )


def report_summary(
    contexts: DataFrame, rolled: DataFrame, counts: DataFrame, recon_lines: DataFrame,
    mappings: DataFrame,
) -> DataFrame:
    """One wide row per report."""
    lines = recon_lines.groupBy("report_id").agg(
        F.count_if(F.col("check_type") == "excel_vs_python").alias("internal_lines"),
        F.count_if(F.col("check_type") == "python_vs_accounts").alias("external_lines"),
        F.coalesce(F.bool_and("is_final"), F.lit(False)).alias("verdicts_are_final"),
    )
    maps = mappings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("mappings"), F.count_if("is_approved").alias("approved_mappings")
    )
    return (
        contexts.join(rolled, "report_id")
        .join(counts, "report_id", "left")
        .join(lines, "report_id", "left")
        .join(maps, "report_id", "left")
    )


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write report tables, bucketed by report.

    Rebalancing on the bucket splits a bucket that holds a very large report over
    several files instead of one task.
    """
    for name, df in tables.items():
        bucket = F.pmod(F.xxhash64("report_id"), F.lit(BUCKETS)).cast("int")
        (
            df.withColumn("bucket", bucket)
            .hint("rebalance", "bucket")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        )
