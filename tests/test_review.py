from ledgerloom.operators import disclosure, evidence, events, graph, report, review, trace
from tests.books import cells, outputs

LINES = "report_id string, line_no int, line_id string, label string, account_number string, ledger_source string, entity string, period string, currency string, evidence_ref string, debit_credit string, amount decimal(38,12)"
RECON = "report_id string, output_ref string, label string, check_type string, source_value double, target_value double, delta double, delta_pct double, verdict string, pct_threshold double, absolute_threshold double, threshold_is_default boolean, completeness string, coverage_pct double, unsupported_count bigint, mapping_id string, is_final boolean"
MAPS = "report_id string, mapping_id string, output_ref string, line_id string, mapping_type string, suggested_by string, suggested_confidence double, approved_by string, approved_at timestamp, approval_note string, is_approved boolean, is_ambiguous boolean"
DECISIONS = "report_id string, mapping_id string, action string, replacement_line_id string, actor string, decided_at timestamp"


def ledger(spark, *rows):
    from decimal import Decimal
    return spark.createDataFrame(
        [("r", i, lid, lab, "300", "TB", "Acme", "2025", "EUR", None, side, Decimal(amount)) for i, (lid, lab, side, amount) in enumerate(rows, 1)], LINES)


def mapping(mid, line, kind="one_to_one", approved=False, who=None, out="P!C5"):
    return ("r", mid, out, line, kind, "fuzzy_match", 94.0, who, None, None, approved, False)


def recon(mid, source=1750.0, target=1755.0, kind="python_vs_accounts", completeness="complete", verdict="warn"):
    d = abs(source - target)
    return ("r", "P!C5", f"line {mid}", kind, source, target, d, d / max(source, target), verdict, 0.01, 100.0, True, completeness, 100.0, 0, mid, False)


def test_control_totals(spark):
    lines = ledger(spark, ("a", "x", "debit", "150"), ("b", "x", "credit", "50"))
    ask = lambda total: review.control_totals(
        spark.createDataFrame([("r", total)], "report_id string, control_total string"), lines).collect()[0]
    assert ask("100").status == "match" and ask(None).status == "not_checked"
    tiny = ledger(spark, ("a", "x", "debit", "0.1"), ("b", "x", "debit", "0.2"), ("c", "x", "credit", "0.05"))
    row = review.control_totals(spark.createDataFrame([("r", "0.24")], "report_id string, control_total string"), tiny).collect()[0]
    assert row.status == "mismatch" and float(row.difference) == 0.01


def test_reviews(spark):
    lines = ledger(spark, ("L1", "A", "debit", "1755"), ("L2", "B", "debit", "1750"), ("L3", "C", "debit", "9"))
    maps = spark.createDataFrame([mapping("M1", "L1"), mapping("M2", "L3"), mapping("M3", "L2", "one_to_many")], MAPS)
    rec = spark.createDataFrame([recon(None, kind="excel_vs_python"), recon("M1"), recon("M2")], RECON)
    decisions = spark.createDataFrame(
        [("r", "M1", "edit", "L2", "A", None), ("r", "M2", "reject", None, "A", None), ("r", "M3", "acknowledge_manual", None, "A", None)], DECISIONS)
    assert review.decision_errors(maps, decisions, lines).isEmpty()
    after, kept = review.apply_reviews(maps, rec, decisions, lines)
    assert {(m.mapping_id, m.line_id, m.is_approved) for m in after.collect()} == {
        ("M1", "L1", False), ("M2", "L3", False), ("M3", "L2", False), ("M1-HUMAN", "L2", True)}
    none = spark.createDataFrame([], "report_id string, check_type string, pct_threshold double, absolute_threshold double")
    final = {r.mapping_id: r for r in review.evaluate_lines(kept, after, none, final=True).collect()}
    assert set(final) == {None, "M1-HUMAN"}
    assert (final["M1-HUMAN"].delta, final["M1-HUMAN"].verdict, final["M1-HUMAN"].label) == (0.0, "pass", "B (L2)")
    unmatched, unmapped = review.population_gaps(after, lines, outputs(spark, "P!C5", "P!D1"))
    assert {r.line_id for r in unmatched.collect()} == {"L1", "L3"}
    assert [r.output_ref for r in unmapped.collect()] == ["P!D1"]
    events_ = {r.payload_json for r in events.mapping_events(maps, decisions).collect()}
    assert any("replaced_with_human_direct_mapping" in p and "M1-HUMAN" in p for p in events_)


def test_bad_decisions(spark):
    lines = ledger(spark, ("L1", "A", "debit", "1"), ("L2", "B", "debit", "1"))
    maps = spark.createDataFrame([mapping("M1", "L1"), mapping("M2", "L1"), mapping("M3", "L2", "one_to_many"), mapping("M4", "L2")], MAPS)
    decisions = spark.createDataFrame(
        [("r", "M1", "edit", "L1", "A", None), ("r", "M2", "edit", "L9", "A", None), ("r", "M3", "approve", None, "A", None),
         ("r", "MX", "approve", "L1", "A", None), ("r", "M2", "reject", None, "A", None)], DECISIONS)
    got = {(r.mapping_id, r.problem) for r in review.decision_errors(maps, decisions, lines).collect()}
    assert got == {
        ("M1", "replacement is the current line"), ("M2", "replacement line does not exist"), ("M2", "more than one decision"),
        ("M3", "action does not fit the mapping type"), ("MX", "unknown mapping"),
        ("MX", "replacement given if and only if action is edit"), ("M4", "no decision")}


def test_thresholds_change_the_verdict(spark):
    rec = spark.createDataFrame([recon("M1")], RECON)
    maps = spark.createDataFrame([mapping("M1", "L1", approved=True)], MAPS)
    for pct, want in ((0.01, "warn"), (0.03, "pass"), (0.001, "block")):
        t = spark.createDataFrame([("r", "python_vs_accounts", pct, 100.0)], "report_id string, check_type string, pct_threshold double, absolute_threshold double")
        row = review.evaluate_lines(rec, maps, t).collect()[0]
        assert (row.verdict, row.threshold_is_default) == (want, pct == 0.01)
    many = spark.createDataFrame([mapping("M1", "L1", "one_to_many", True)], MAPS)
    t = spark.createDataFrame([("r", "python_vs_accounts", 0.03, 100.0)], "report_id string, check_type string, pct_threshold double, absolute_threshold double")
    assert review.evaluate_lines(rec, many, t).collect()[0].verdict == "warn"


def test_trace_statuses(spark):
    lines = ledger(spark, ("L1", "A", "debit", "1755"), ("L4", "D", "credit", "7"))
    maps = spark.createDataFrame(
        [mapping("M1", "L1", approved=True, who="A"), mapping("M2", "L1"), mapping("M3", "L1", "one_to_many", True), mapping("M4", "gone", approved=True)], MAPS)
    rec = spark.createDataFrame(
        [recon("M1"), recon("M2"), recon("M3"), recon("M4"), recon("M9"), recon(None), recon(None, kind="excel_vs_python", completeness="partial")], RECON)
    found = spark.createDataFrame([("r", "F0001", "P", "C5", "bad")], "report_id string, finding_id string, tab_key string, cell_ref string, description string")
    unmatched = spark.createDataFrame([("r", "L4"), ("r", "L?")], "report_id string, line_id string")
    rows = trace.trace_index(rec, maps, lines, unmatched, found).collect()
    by = {(r.section, r.figure_key): r for r in rows}
    assert {k[1]: r.trace_status for k, r in by.items() if k[0] == 2} == {
        "M1": "traced", "M2": "mapping_pending_approval", "M3": "mapping_rejected", "M4": "not_traceable",
        "M9": "not_traceable", "line None": "unmapped"}
    assert by[2, "M1"].provenance.account_number == "300" and by[2, "M2"].provenance is None
    assert by[1, "P!C5"].trace_status == "partially_traced"
    assert by[3, "L4"].report_value == -7.0 and by[3, "L?"].report_value is None
    top = trace.first_entries(trace.trace_index(rec, maps, lines, unmatched, found), "r", 3).collect()
    assert len(top) == 3 and top[0].first_source_cell == "P!C5"


def test_disclosure(spark):
    book = cells(spark, {
        "P!A1": "short label", "P!A2": "x" * 39, "P!A3": "x" * 40, "P!A4": "='[b.XLSX]S'!A1", "P!A5": True,
        "P!B1": "=H!A1", "H!A1": 5, "H!A2": 6, "C!A1": "=P!B1", "C!A2": "=H!A2"})
    edges = graph.cell_edges(book)
    ask = spark.createDataFrame([("w", "P")], "workbook_id string, tab_key string")
    scope = disclosure.cells_in_scope(ask, book, edges, outputs(spark, "C!A1", "C!A2"))
    got = {r.node: r.reason for r in disclosure.decide(ask, book, scope).collect()}
    assert {k for k, v in got.items() if v is None} == {"P!A1", "P!A2", "P!B1", "H!A1", "C!A1"}
    assert got["P!A3"] == disclosure.FREE_TEXT and got["P!A4"] == disclosure.EXTERNAL_LINK
    assert got["P!A5"] == disclosure.TYPE_NOT_ALLOWED
    assert got["H!A2"] == got["C!A2"] == disclosure.OUT_OF_SCOPE
    names = spark.createDataFrame([("w", "P", "rate", "H!A1"), ("w", "workbook", "x", "'P'!$A$1"), ("w", "H", "y", "H!A1")],
                                  "workbook_id string, scope string, name string, definition string")
    row = disclosure.manifest(ask, book, scope, outputs(spark, "C!A1", "P!B1"), names).collect()[0]
    assert (row.included, row.excluded, row.out_of_scope, row.free_text) == (5, 5, 2, 1)
    import json
    sent = {r.node: json.loads(r.j) for r in book.select("node", disclosure.cell_payload(book).alias("j")).collect() if got[r.node] is None}
    payload = {"tab_name": "P", "cells": sent, "named_ranges": ["rate", "x"], "authoritative_outputs": ["P!B1"], "withheld_cell_count": 5}
    assert row.payload_chars == len(json.dumps(payload, sort_keys=True, separators=(",", ":")))


EVENTS = "report_id string, event_no bigint, event_type string, payload_json string, ts string, actor string"


def some_events(spark, n=9):
    return spark.createDataFrame(
        [("ab"[i % 2], i, "gate_decision", '{"gate":%d,"acknowledge_incomplete":%s}' % (i % 4, str(i % 3 == 0).lower()), f"t{i}", "A") for i in range(n)], EVENTS)


def test_chain_and_tampering(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(evidence, "RUN_LENGTH", 4)
    log = evidence.append_events(some_events(spark))
    rows = log.orderBy("row_id").collect()
    prev = evidence.GENESIS
    for r in rows:
        assert r.prev_row_hash == prev
        prev = hashlib.sha256((prev + r.payload_hash + r.ts).encode()).hexdigest()
        assert r.row_hash == prev
    bad = lambda df, **kw: [(r.row_id, r.problem) for r in evidence.broken_rows(df, **kw).orderBy("row_id").collect()]
    assert bad(log) == []
    from pyspark.sql import functions as F
    assert bad(log.filter("row_id != 3")) == [(4, "link")]
    assert bad(log.withColumn("payload_json", F.when(F.col("row_id") == 2, "{}").otherwise(F.col("payload_json")))) == [(2, "payload")]
    assert bad(log.withColumn("ts", F.when(F.col("row_id") == 5, "x").otherwise(F.col("ts")))) == [(5, "row")]
    assert bad(log.withColumn("row_hash", F.when(F.col("row_id") == 5, "x").otherwise(F.col("row_hash")))) == [(5, "row"), (6, "link")]
    more = evidence.append_events(
        some_events(spark, 3).withColumn("event_no", F.col("event_no") + 100),
        spark.createDataFrame([(prev,)], "row_hash string"))
    assert bad(log.unionByName(more)) == []
    own = evidence.append_events(some_events(spark), keys=["report_id"], cover_all=True)
    assert bad(own, keys=["report_id"], cover_all=True) == []
    assert bad(own.withColumn("actor", F.lit("B")), keys=["report_id"], cover_all=True) != []
    anchor = evidence.anchor_heads(own, "t")
    assert anchor.count() == 2 and bad(anchor, cover_all=True) == []


def test_recovery(spark):
    states = evidence.snapshot_rows(spark.createDataFrame(
        [("a", 1, "g1", "t", "{}"), ("a", 2, "g1", "t", '{"x":1}'), ("b", 3, "g1", "t", '{"y":1}'), ("c", 4, "g2", "t", "{}")],
        "report_id string, snapshot_id bigint, gate_name string, captured_at string, state_json string"))
    from pyspark.sql import functions as F
    batch = evidence.snapshot_events(states.filter("report_id != 'c'")).withColumns(
        {"event_no": F.col("snapshot_id"), "actor": F.lit("A")}).drop("snapshot_id")
    log = evidence.append_events(batch)
    latest = evidence.latest_snapshots(states, ["report_id"])
    changed = latest.withColumn("state_json", F.when(F.col("report_id") == "b", "{ }").otherwise(F.col("state_json")))
    status = {r.report_id: r.recovery_status for r in evidence.recovery_status(changed, log).collect()}
    assert status == {"a": "recoverable", "b": "content_mismatch", "c": "no_commitment"}
    broken = log.filter("row_id != 1")
    assert {r.recovery_status for r in evidence.recovery_status(changed, broken).collect()} == {"chain_broken"}
    assert evidence.latest_snapshots(states, ["report_id", "gate_name"]).count() == 3
    assert '"verified_rows":3' in evidence.verification_events(latest, log).collect()[0].payload_json


def test_events_and_approval(spark):
    log = evidence.append_events(some_events(spark))
    ack = {r.report_id: r.acknowledge_incomplete for r in report.acknowledgements(log).collect()}
    assert ack == {"b": False}
    approvals = spark.createDataFrame([("a", " a", "cfo"), ("b", "B", "cfo"), ("c", "A", "cfo"), ("d", " ", "x")], "report_id string, approval_name string, role string")
    approvers = spark.createDataFrame([("A ",)], "name string")
    said = {r.report_id: (r.preparers, r.same_person) for r in events.independence(approvals, log).collect()}
    assert said["a"][1] is True and said["c"] == (None, None) and said["b"] == ("A", False)
    made = events.approval_events(approvals, approvers, log).collect()
    assert sorted(r.event_type for r in made) == ["gate_decision"] + ["report_approved"] * 3
    whole = evidence.with_context
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "p string")
    got = [r[0] for r in df.select(whole(F.col("p"), F.struct(F.lit("v").alias("code_version")))).collect()]
    assert got == ['{"context":{"code_version":"v"}}', '{"a":1,"context":{"code_version":"v"}}']


def test_write_report_tables(spark, tmp_path):
    df = spark.range(50).selectExpr("cast(id % 3 as string) as report_id", "id")
    report.write_tables({"lines": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/lines").count() == 50
