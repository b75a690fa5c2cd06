"""Checks, reviews and verdict roll-ups of the reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.amounts import (
    DEFAULT_ABS, DEFAULT_PCT, MONEY, delta, delta_pct, signed_amount, verdict, verdict_of_rank,
    verdict_rank,
)
from ledgerloom.functions.texts import is_sha256, same_text, text_or_empty


# -- context and identity ----------------------------------------------------


def compare_contexts(contexts: DataFrame, extracts: DataFrame) -> DataFrame:
    """Entity, period and currency decide; a different basis only warns."""
    other = extracts.select(
        "report_id", *[F.col(c).alias(f"_{c}") for c in ("entity", "period", "currency", "basis")],
        F.lit(True).alias("_there"),
    )
    agree = [same_text(F.col(c), F.col(f"_{c}")) for c in ("entity", "period", "currency")]
    return contexts.join(other, "report_id", "left").select(
        "report_id",
        F.when(F.col("_there").isNull(), "not_checked")
        .when(agree[0] & agree[1] & agree[2], "match")
        .otherwise("mismatch")
        .alias("context_match"),
        F.when(
            F.col("_there") & ~same_text(F.col("basis"), F.col("_basis")),
            F.format_string(
                "basis differs: workbook says '%s', reference figures say '%s'",
                F.coalesce("basis", F.lit("None")), F.coalesce("_basis", F.lit("None")),
            ),
        ).alias("basis_warning"),
    )


def file_identity(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Hash of the bytes against the confirmed hash.

    ``files``: report_id, content. ``contexts``: report_id, confirmed_hash, filename.
    """
    observed = files.select("report_id", F.sha2("content", 256).alias("observed_hash"))
    confirmed = F.when(is_sha256(F.col("confirmed_hash")), F.col("confirmed_hash"))
    return contexts.join(observed, "report_id", "left").select(
        "report_id", "filename",
        F.coalesce(confirmed, F.lit("not_yet_parsed")).alias("confirmed_workbook_hash"),
        F.coalesce("observed_hash", F.lit("unreadable")).alias("observed_workbook_hash"),
        F.coalesce(confirmed == F.col("observed_hash"), F.lit(False)).alias("is_match"),
    )


def control_totals(extracts: DataFrame, lines: DataFrame) -> DataFrame:
    """Signed sum of an extract's lines against its declared total, exactly."""
    total = lines.groupBy("report_id").agg(
        F.sum(signed_amount(F.col("amount"), F.col("debit_credit"))).cast(MONEY).alias("signed_total")
    )
    declared = F.col("control_total").cast(MONEY)
    found = F.coalesce("signed_total", F.lit(0).cast(MONEY))
    return extracts.join(total, "report_id", "left").select(
        "report_id",
        F.when(declared.isNull(), "not_checked").when(found == declared, "match").otherwise("mismatch").alias("status"),
        declared.alias("declared_total"),
        F.when(declared.isNotNull(), found).alias("signed_total"),
        F.when(declared.isNotNull(), (found - declared).cast(MONEY)).alias("difference"),
    )


# -- findings and outputs ----------------------------------------------------


def undecided_findings(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings without a decision, or overridden/dismissed without a reason."""
    d = decisions.select("report_id", "finding_id", "decision", "reason")
    return (
        findings.join(d, ["report_id", "finding_id"], "left")
        .withColumn(
            "problem",
            F.when(F.col("decision").isNull(), "no decision").when(
                (F.col("decision") != "confirmed") & (text_or_empty(F.col("reason")) == ""), "no reason"
            ),
        )
        .filter("problem is not null")
        .select("report_id", "finding_id", "severity", "problem")
    )


def output_errors(reports: DataFrame, outputs: DataFrame, cells: DataFrame) -> DataFrame:
    """Designated outputs that are no cells, and reports without any output."""
    known = cells.select("workbook_id", F.col("node").alias("output_ref"))
    unknown = outputs.join(known, ["workbook_id", "output_ref"], "left_anti").select(
        "report_id", "output_ref", F.lit("does not exist in the workbook").alias("problem")
    )
    none = reports.join(outputs, "report_id", "left_anti").select(
        "report_id", F.lit(None).cast("string").alias("output_ref"),
        F.lit("the report names no output").alias("problem"),
    )
    return unknown.unionByName(none)


def finding_counts(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Totals, blockers, blockers set aside, and decided findings per report."""
    d = decisions.select("report_id", "finding_id", "decision")
    blocker = F.col("severity") == "blocker"
    return (
        findings.join(d, ["report_id", "finding_id"], "left")
        .groupBy("report_id")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            F.count_if(blocker).alias("blockers"),
            F.count_if(blocker & F.col("decision").isin("overridden", "dismissed")).alias("blockers_resolved"),
            F.count("decision").alias("decided"),
            F.bool_or(blocker & (F.col("decision") == "confirmed")).alias("has_confirmed_blocker"),
        )
        .withColumn("has_confirmed_blocker", F.coalesce("has_confirmed_blocker", F.lit(False)))
    )


# -- mapping review ----------------------------------------------------------


def decision_errors(
    mappings: DataFrame, decisions: DataFrame, lines: DataFrame, require_complete: bool = True
) -> DataFrame:
    """Everything that makes a set of mapping decisions unacceptable.

    Unlike the other checks, ``duplicate_target`` is a warning.
    """
    key = ["report_id", "mapping_id"]
    replacement = text_or_empty(F.col("replacement_line_id"))
    edit = F.col("action") == "edit"

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(*key, F.lit(kind).alias("problem"))

    double = decisions.groupBy(*key).count().filter("count > 1")
    unknown = decisions.join(mappings, key, "left_anti")
    shape = decisions.filter(edit != (replacement != ""))
    known = decisions.join(mappings.select(*key, "mapping_type", "line_id"), key)
    manual = F.col("action") == "acknowledge_manual"
    wrong = known.filter((F.col("mapping_type") == "one_to_one") == manual)
    edits = known.filter(edit & (F.col("mapping_type") == "one_to_one"))
    same = edits.filter(replacement == F.col("line_id"))
    target = lines.select("report_id", F.col("line_id").alias("_target"))
    absent = edits.withColumn("_target", replacement).join(target, ["report_id", "_target"], "left_anti")
    crowded = edits.withColumn("_target", replacement)
    crowded = crowded.join(
        crowded.groupBy("report_id", "_target").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"),
        ["report_id", "_target"],
    )
    found = (
        rows(double, "more than one decision")
        .unionByName(rows(unknown, "unknown mapping").distinct())
        .unionByName(rows(shape, "replacement given if and only if action is edit"))
        .unionByName(rows(wrong, "action does not fit the mapping type"))
        .unionByName(rows(same, "replacement is the current line"))
        .unionByName(rows(absent, "replacement line does not exist"))
        .unionByName(rows(crowded, "duplicate_target"))
    )
    if require_complete:
        found = found.unionByName(
            rows(mappings.join(decisions, key, "left_anti"), "no decision")
        )
    return found


def unreviewed_mappings(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    return mappings.join(decisions, ["report_id", "mapping_id"], "left_anti").select(
        "report_id", "mapping_id"
    )


def apply_reviews(
    mappings: DataFrame, recon_lines: DataFrame, decisions: DataFrame, lines: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(mappings, recon lines) after the decisions.

    Approvals are set from scratch. An edit leaves the proposal unapproved and
    adds ``<id>-HUMAN`` with the replacement line and its amount. Second-pass
    lines survive only with an approved mapping.
    """
    key = ["report_id", "mapping_id"]
    d = decisions.select(*key, "action", "replacement_line_id", "actor", "decided_at")
    ruled = mappings.join(d, key, "left")
    approve = F.coalesce(
        (F.col("action") == "approve") & (F.col("mapping_type") == "one_to_one"), F.lit(False)
    )
    reviewed = ruled.withColumns(
        {
            "is_approved": approve,
            "approved_by": F.when(approve, F.col("actor")),
            "approved_at": F.when(approve, F.col("decided_at")),
        }
    )
    target = lines.select(
        "report_id", F.col("line_id").alias("_new_id"), F.col("label").alias("_new_label"),
        signed_amount(F.col("amount"), F.col("debit_credit")).cast("double").alias("_new_value"),
    )
    edits = (
        ruled.filter((F.col("action") == "edit") & (F.col("mapping_type") == "one_to_one"))
        .withColumn("_new_id", text_or_empty(F.col("replacement_line_id")))
        .filter("_new_id != line_id")
        .join(target, ["report_id", "_new_id"])
    )
    human = F.concat("mapping_id", F.lit("-HUMAN"))
    added = edits.withColumns(
        {
            "mapping_id": human, "line_id": F.col("_new_id"),
            "suggested_by": F.lit("human_direct"),
            "suggested_confidence": F.lit(None).cast("double"),
            "approval_note": F.lit(None).cast("string"),
            "approved_by": F.col("actor"), "approved_at": F.col("decided_at"),
            "is_approved": F.lit(True), "is_ambiguous": F.lit(False),
        }
    ).select(*mappings.columns)
    after = reviewed.select(*mappings.columns).unionByName(added)

    approved = after.filter("is_approved").select(*key)
    kept = recon_lines.filter("check_type = 'excel_vs_python'").unionByName(
        recon_lines.filter("check_type = 'python_vs_accounts'").join(approved, key, "left_semi")
        .select(*recon_lines.columns)
    )
    replaced = recon_lines.filter("check_type = 'python_vs_accounts'").join(
        edits.select(*key, "_new_id", "_new_label", "_new_value"), key
    )
    a, b = F.col("source_value"), F.col("_new_value")
    replaced = replaced.withColumns(
        {
            "mapping_id": human,
            "label": F.concat("_new_label", F.lit(" ("), "_new_id", F.lit(")")),
            "delta": delta(a, b), "delta_pct": delta_pct(a, b), "target_value": b,
        }
    ).select(*recon_lines.columns)
    return after, kept.unionByName(replaced)


def population_gaps(
    mappings: DataFrame, lines: DataFrame, outputs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Ledger lines and outputs left without an approved mapping."""
    approved = mappings.filter("is_approved")
    return (
        lines.join(approved, ["report_id", "line_id"], "left_anti"),
        outputs.join(lines.select("report_id").distinct(), "report_id", "left_semi").join(
            approved, ["report_id", "output_ref"], "left_anti"
        ),
    )


def mapping_violations(recon_lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """Second-pass lines whose mapping is missing or not approved."""
    known = mappings.select("report_id", "mapping_id", "is_approved")
    return (
        recon_lines.filter("check_type = 'python_vs_accounts'")
        .join(known, ["report_id", "mapping_id"], "left")
        .withColumn(
            "problem",
            F.when(F.col("mapping_id").isNull(), "no mapping_id")
            .when(F.col("is_approved").isNull(), "mapping not in result")
            .when(~F.col("is_approved"), "mapping not approved"),
        )
        .filter("problem is not null")
        .select("report_id", "label", "mapping_id", "problem")
    )


# -- thresholds and verdicts -------------------------------------------------


def deviates(pct: Column, absolute: Column, default_pct: float, default_abs: float) -> Column:
    return (pct != default_pct) | (absolute != default_abs)


def unexplained_thresholds(
    thresholds: DataFrame, default_pct: float = DEFAULT_PCT, default_abs: float = DEFAULT_ABS
) -> DataFrame:
    """Changed thresholds without a stated reason, per report and pass."""
    changed = deviates(F.col("pct_threshold"), F.col("absolute_threshold"), default_pct, default_abs)
    return thresholds.filter(changed & (text_or_empty(F.col("reason")) == ""))


def evaluate_lines(
    recon_lines: DataFrame,
    mappings: DataFrame,
    thresholds: DataFrame,
    default_pct: float = DEFAULT_PCT,
    default_abs: float = DEFAULT_ABS,
    final: bool = False,
) -> DataFrame:
    """Verdicts again, under approved thresholds per report and pass.

    At this stage only a mapping that is not one-to-one counts as ambiguous. The
    preview is the same plan with ``final=False``.
    """
    t = thresholds.select(
        "report_id", "check_type", F.col("pct_threshold").alias("_pct"),
        F.col("absolute_threshold").alias("_abs"),
    )
    kinds = mappings.select("report_id", "mapping_id", "mapping_type")
    pct, absolute = F.coalesce("_pct", F.lit(default_pct)), F.coalesce("_abs", F.lit(default_abs))
    ambiguous = (F.col("check_type") != "excel_vs_python") & (F.col("mapping_type") != "one_to_one")
    return (
        recon_lines.join(t, ["report_id", "check_type"], "left")
        .join(kinds, ["report_id", "mapping_id"], "left")
        .withColumns(
            {
                "verdict": verdict(
                    F.col("delta"), F.col("delta_pct"), pct, absolute, F.col("completeness"), ambiguous
                ),
                "pct_threshold": pct,
                "absolute_threshold": absolute,
                "threshold_is_default": ~deviates(pct, absolute, default_pct, default_abs),
                "is_final": F.lit(final),
            }
        )
        .select(*recon_lines.columns)
    )


def worst_verdicts(reports: DataFrame, lines: DataFrame, empty: str) -> DataFrame:
    """Worst verdict of each report; a report without lines gets ``empty``."""
    worst = lines.groupBy("report_id").agg(F.max(verdict_rank(F.col("verdict"))).alias("_rank"))
    return reports.select("report_id").join(worst, "report_id", "left").select(
        "report_id", F.coalesce(verdict_of_rank(F.col("_rank")), F.lit(empty)).alias("verdict")
    )


def roll_up(
    contexts: DataFrame,
    lines: DataFrame,
    unmatched: DataFrame,
    unmapped: DataFrame,
    controls: DataFrame,
    counts: DataFrame,
) -> DataFrame:
    """Internal, external and overall verdict of each report.

    ``contexts`` is the result of :func:`compare_contexts`. A population gap turns
    a pass or warning into incomplete; a context or control mismatch, or a
    confirmed blocker, blocks.
    """
    per_pass = lines.groupBy("report_id").agg(
        F.max(F.when(F.col("check_type") == "excel_vs_python", verdict_rank(F.col("verdict")))).alias("_in"),
        F.max(F.when(F.col("check_type") == "python_vs_accounts", verdict_rank(F.col("verdict")))).alias("_ex"),
    )
    gaps = (
        unmatched.select("report_id").unionByName(unmapped.select("report_id"))
        .groupBy("report_id").agg(F.count(F.lit(1)).alias("gaps"))
    )
    flags = counts.select("report_id", "has_confirmed_blocker")
    external = F.coalesce(
        verdict_of_rank(F.col("_ex")),
        F.when(F.col("context_match") == "not_checked", "not_performed").otherwise("incomplete"),
    )
    joined = (
        contexts.select("report_id", "context_match")
        .join(per_pass, "report_id", "left")
        .join(gaps, "report_id", "left")
        .join(controls.select("report_id", F.col("status").alias("control_status")), "report_id", "left")
        .join(flags, "report_id", "left")
        .withColumns(
            {
                "gaps": F.coalesce("gaps", F.lit(0)),
                "control_status": F.coalesce("control_status", F.lit("not_checked")),
                "internal_verdict": F.coalesce(verdict_of_rank(F.col("_in")), F.lit("incomplete")),
                "_plain": external,
            }
        )
        .withColumn(
            "external_verdict",
            F.when(
                (F.col("context_match") == "mismatch") | (F.col("control_status") == "mismatch"), "block"
            )
            .when(
                (F.col("gaps") > 0) & F.col("_plain").isin("pass", "warn", "not_performed"), "incomplete"
            )
            .otherwise(F.col("_plain")),
        )
    )
    overall = F.when(F.coalesce("has_confirmed_blocker", F.lit(False)), "block").otherwise(
        verdict_of_rank(
            F.greatest(verdict_rank(F.col("internal_verdict")), verdict_rank(F.col("external_verdict")))
        )
    )
    return joined.withColumn("overall_verdict", overall).select(
        "report_id", "context_match", "control_status", "gaps", "internal_verdict",
        "external_verdict", "overall_verdict",
    )


def gate_status(rolled: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """May a report proceed: any block stops, incomplete needs an acknowledgement."""
    both = F.array("internal_verdict", "external_verdict")
    return rolled.join(
        acknowledged.select("report_id", "acknowledge_incomplete"), "report_id", "left"
    ).withColumn(
        "gate_status",
        F.when(F.array_contains(both, "block"), "blocked")
        .when(
            F.array_contains(both, "incomplete") & ~F.coalesce("acknowledge_incomplete", F.lit(False)),
            "needs_acknowledgement",
        )
        .otherwise("open"),
    )


def report_flags(lines: DataFrame, rolled: DataFrame) -> DataFrame:
    """has_blocker and is_incomplete per report, as shown before submission."""
    blocked = lines.groupBy("report_id").agg(F.bool_or(F.col("verdict") == "block").alias("_line"))
    both = F.array("internal_verdict", "external_verdict")
    return rolled.join(blocked, "report_id", "left").select(
        "report_id",
        (F.array_contains(both, "block") | F.coalesce("_line", F.lit(False))).alias("has_blocker"),
        F.array_contains(both, "incomplete").alias("is_incomplete"),
    )
