"""Gate decisions as event rows, ready for the log.

Payload fields are declared in alphabetical order, which is the canonical order.
Lists that grow with the data are written in numbered parts of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.texts import same_text, text_or_empty
from ledgerloom.operators.numbering import numbered
from ledgerloom.operators.review import deviates

PART = 1000
KEEP_NULLS = {"ignoreNullFields": "false"}


def _event(df: DataFrame, event_type: str, *fields: Column | str) -> DataFrame:
    return df.select(
        "report_id", F.lit(event_type).alias("event_type"),
        F.to_json(F.struct(*fields), KEEP_NULLS).alias("payload_json"),
        "actor",
    )


def _named(value, name: str) -> Column:
    return F.lit(value).alias(name)


def identity_events(identity: DataFrame) -> DataFrame:
    """One event per workbook whose bytes are not those confirmed, with both hashes."""
    return _event(
        identity.filter("not is_match").withColumn("actor", F.lit(None).cast("string")),
        "workbook_identity_mismatch",
        "confirmed_workbook_hash", "filename", "observed_workbook_hash", _named("blocked", "outcome"),
    )


def context_events(contexts: DataFrame, compared: DataFrame, controls: DataFrame) -> DataFrame:
    """``contexts``: report_id, filename, description, actor."""
    joined = contexts.select("report_id", "filename", "description", "actor").join(
        compared, "report_id"
    ).join(controls, "report_id", "left")
    check = F.struct(
        "declared_total", "difference", "signed_total",
        F.coalesce("status", F.lit("not_checked")).alias("status"),
    )
    return _event(
        joined, "gate_decision",
        _named("context_confirmed", "action"), "basis_warning",
        F.col("context_match").alias("context_match_verdict"), check.alias("control_total_check"),
        "description", "filename", _named(1, "gate"),
    )


def in_parts(df: DataFrame, item: Column, order: list[Column], coarse: list[Column]) -> DataFrame:
    """Gather items per report into parts of at most ``PART``, in order."""
    rows = numbered(df, ["report_id"], coarse, order, "_no")
    return (
        rows.groupBy("report_id", F.floor((F.col("_no") - 1) / PART).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_no", item.alias("item")))).alias("_items"))
        .select("report_id", "part", F.transform("_items", lambda x: x["item"]).alias("items"))
    )


def disposition_events(
    findings: DataFrame, decisions: DataFrame, actors: DataFrame
) -> DataFrame:
    """Every disposition of a report's findings. ``actors``: report_id, actor."""
    item = F.struct(
        "decided_by", F.col("decision").alias("disposition"), "finding_id", "reason", "severity"
    )
    parts = in_parts(
        findings.select("report_id", "finding_id", "finding_no", "severity").join(
            decisions.select("report_id", "finding_id", "decision", "reason", "decided_by"),
            ["report_id", "finding_id"],
        ),
        item, [F.col("finding_no")], [F.floor(F.col("finding_no") / 4096)],
    )
    return _event(
        parts.join(actors, "report_id"), "gate_decision",
        _named("findings_reviewed_and_outputs_designated", "action"),
        F.col("items").alias("dispositions"), _named(2, "gate"), "part",
    )


def output_events(outputs: DataFrame, actors: DataFrame) -> DataFrame:
    """The designated outputs of a report."""
    parts = in_parts(
        outputs, F.col("output_ref"), [F.col("output_pos")], [F.floor(F.col("output_pos") / 4096)]
    )
    return _event(
        parts.join(actors, "report_id"), "gate_decision",
        _named("findings_reviewed_and_outputs_designated", "action"),
        F.col("items").alias("authoritative_outputs"), _named(2, "gate"), "part",
    )


def reconciliation_events(
    rolled: DataFrame, thresholds: DataFrame, acknowledged: DataFrame, actors: DataFrame,
    default_pct: float, default_abs: float,
) -> DataFrame:
    """Verdicts, gap count and threshold deviations of both passes."""
    deviation = F.struct(
        "absolute_threshold",
        F.lit(default_abs).alias("default_absolute_threshold"),
        F.lit(default_pct).alias("default_pct_threshold"),
        deviates(F.col("pct_threshold"), F.col("absolute_threshold"), default_pct, default_abs).alias("deviated"),
        "pct_threshold", "reason",
    )
    per_report = thresholds.groupBy("report_id").agg(
        F.max(F.when(F.col("check_type") == "excel_vs_python", deviation)).alias("internal"),
        F.max(F.when(F.col("check_type") == "python_vs_accounts", deviation)).alias("external"),
    )
    joined = (
        rolled.join(per_report, "report_id", "left")
        .join(acknowledged.select("report_id", "acknowledge_incomplete"), "report_id", "left")
        .join(actors, "report_id")
    )
    return _event(
        joined, "gate_decision",
        F.coalesce("acknowledge_incomplete", F.lit(False)).alias("acknowledge_incomplete"),
        _named("reconciliation_reviewed", "action"),
        F.col("context_match").alias("context_match_verdict"),
        F.col("control_status").alias("control_total_verdict"),
        "external_verdict", _named(3, "gate"), "internal_verdict",
        F.col("gaps").alias("population_gaps"),
        F.struct("external", "internal").alias("threshold_deviation"),
    )


def mapping_events(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """One event per decided mapping."""
    d = decisions.select("report_id", "mapping_id", "action", "replacement_line_id", "actor")
    joined = mappings.select("report_id", "mapping_id", "mapping_type", "line_id", "output_ref").join(
        d, ["report_id", "mapping_id"]
    )
    taken = (
        F.when(F.col("mapping_type") != "one_to_one", "acknowledged_manual_reconciliation")
        .when(F.col("action") == "approve", "approved")
        .when(F.col("action") == "reject", "rejected")
        .otherwise("replaced_with_human_direct_mapping")
    )
    edited = taken == "replaced_with_human_direct_mapping"
    return _event(
        joined, "mapping_decision",
        taken.alias("action"), "mapping_id", F.col("output_ref").alias("python_output_cell_ref"),
        F.when(~edited, F.col("line_id")).alias("reference_line_id"),
        F.when(edited, F.concat("mapping_id", F.lit("-HUMAN"))).alias("replacement_mapping_id"),
        F.when(edited, text_or_empty(F.col("replacement_line_id"))).alias("replacement_reference_line_id"),
    )


def registered(approvals: DataFrame, approvers: DataFrame) -> DataFrame:
    """Is the approving name in the registry, case and outer spaces aside.

    The registry is joined on its normal form, whatever its size.
    """
    plain = lambda c: F.lower(text_or_empty(F.col(c)))
    names = approvers.select(plain("name").alias("_name")).distinct().withColumn("_known", F.lit(True))
    return (
        approvals.withColumn("_name", plain("approval_name"))
        .join(names, "_name", "left")
        .withColumn("name_in_registry", F.coalesce("_known", F.lit(False)))
        .drop("_name", "_known")
    )


def preparers(log: DataFrame) -> DataFrame:
    """Actors of second and third gate decisions."""
    gate = F.get_json_object("payload_json", "$.gate")
    return (
        log.filter((F.col("event_type") == "gate_decision") & gate.isin("2", "3"))
        .filter(F.coalesce("actor", F.lit("")) != "")
        .select("report_id", "actor").distinct()
    )


def independence(approvals: DataFrame, log: DataFrame) -> DataFrame:
    """``preparers`` of each approved report, and whether all of them are the approver.

    Both are null where nobody else is recorded. The people who prepared one report
    are few; their distinct names are gathered in one text.
    """
    named = preparers(log).join(approvals.select("report_id", "approval_name"), "report_id").groupBy(
        "report_id"
    ).agg(
        F.array_join(F.array_sort(F.collect_set("actor")), ", ").alias("preparers"),
        F.bool_and(same_text(F.col("actor"), F.col("approval_name"))).alias("same_person"),
    )
    return approvals.join(named, "report_id", "left")


def approval_events(approvals: DataFrame, approvers: DataFrame, log: DataFrame) -> DataFrame:
    """Approval events, and one more for each name that is not registered.

    ``approvals``: report_id, approval_name, role. Nameless approvals are left out.
    """
    judged = independence(
        registered(approvals.filter(text_or_empty(F.col("approval_name")) != ""), approvers), log
    ).withColumn("actor", F.col("approval_name"))
    unknown = _event(
        judged.filter("not name_in_registry"), "gate_decision",
        _named("approval_record_unregistered_name", "action"), "approval_name", _named(4, "gate"),
    )
    return unknown.unionByName(
        _event(
            judged, "report_approved",
            _named("approval_record_created", "action"), "approval_name", _named(4, "gate"),
            "preparers", "same_person", "name_in_registry", "role",
        )
    )
