"""The queries again as plain SQL, from the conditions that shaped the data.

Nothing here parses a formula: what a check must find follows from the flags that
put it there.
"""

from __future__ import annotations

ROWS = """
lines AS (
  SELECT l_orderkey AS k, l_partkey, l_extendedprice AS price, l_discount AS discount, l_returnflag = 'R' AS returned,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_discount, l_returnflag) AS INTEGER) AS rn
  FROM lineitem),
heads AS (
  SELECT o_orderkey AS k, 'wb-' || o_orderkey AS wb, o_totalprice AS total, o_orderpriority AS pri,
         o_orderstatus AS st, CAST(n AS INTEGER) AS n
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey),
kinds AS (
  SELECT *, pri = '5-LOW' AS lookup, pri = '1-URGENT' AND n >= 3 AS skips, st = 'P' AS ring FROM heads)
"""

# Rebuilt values and chain sizes of the two outputs of each order workbook.
VALUES = ROWS + """,
nets AS (
  SELECT k, rn, returned,
         CASE WHEN returned THEN price * 0.95 ELSE price * (1 - discount) END AS net FROM lines),
sums AS (
  SELECT h.k, h.wb, h.n, h.total, h.lookup,
         sum(CASE WHEN skips AND rn = 2 THEN 0 ELSE net END) AS value,
         sum(CASE WHEN skips AND rn = 2 THEN 0 WHEN returned THEN 2 ELSE 3 END) AS below
  FROM kinds h JOIN nets USING (k) GROUP BY ALL),
outs AS (
  SELECT wb, n, k, 0 AS pos, 'Lines!B' || (n + 1) AS ref, 'Order total' AS label, total AS src,
         CASE WHEN NOT lookup THEN value END AS val,
         CASE WHEN lookup THEN 1 ELSE 1 + below END AS nodes,
         CASE WHEN lookup THEN 0 ELSE 1 + below END AS good, lookup FROM sums
  UNION ALL
  SELECT wb, n, k, 1, 'Summary!B1', 'Net of charge', total * 1.1,
         CASE WHEN NOT lookup THEN value * 1.1 END,
         CASE WHEN lookup THEN 3 ELSE 3 + below END,
         CASE WHEN lookup THEN 2 ELSE 3 + below END, lookup FROM sums)
"""

LEDGER = VALUES + """,
exact AS (
  SELECT k, round(sum(CASE WHEN returned THEN CAST(price AS DECIMAL(18,2)) * CAST(0.95 AS DECIMAL(4,2))
         ELSE CAST(price AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(discount AS DECIMAL(4,2))) END), 2) AS net
  FROM lines GROUP BY k),
ledger AS (
  SELECT k, wb, 1 AS no, 'Order totals' AS label, '4000' AS account,
         CAST(net + CASE WHEN k % 5 = 0 THEN 50 ELSE 0 END AS DOUBLE) AS amount FROM heads JOIN exact USING (k)
  UNION ALL
  SELECT k, wb, 2, 'Net of charges', '4100',
         CAST(round(CAST(total AS DECIMAL(18,2)) * CAST(1.1 AS DECIMAL(4,2)), 2) AS DOUBLE) FROM heads
  UNION ALL SELECT k, wb, 3, 'Freight insurance', '4200', -25.0 FROM heads WHERE k % 4 = 0
  UNION ALL SELECT k, wb, 4, 'Order total', '4300', CAST(net AS DOUBLE) FROM heads JOIN exact USING (k) WHERE k % 6 = 0)
"""


def verdict(d: str, p: str, pct: str, absolute: str, partial: str, unsure: str = "FALSE") -> str:
    return f"""CASE WHEN {partial} OR {d} IS NULL THEN 'incomplete'
      WHEN {d} = 0 AND {p} = 0 THEN CASE WHEN {unsure} THEN 'warn' ELSE 'pass' END
      WHEN {p} >= {pct} OR {d} >= {absolute} THEN 'block'
      WHEN {p} >= {pct} / 10 OR {d} >= {absolute} / 10 OR {unsure} THEN 'warn' ELSE 'pass' END"""


def share(a: str, b: str) -> str:
    return f"""CASE WHEN greatest(abs({a}), abs({b})) < 1e-9 THEN 0.0
      ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) END"""


DELTAS = f"""
sums AS (
  SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))
         * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS b
  FROM lineitem GROUP BY 1),
deltas AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS a, b, abs(o_totalprice - b) AS d,
         CASE WHEN b IS NOT NULL THEN {share('o_totalprice', 'b')} END AS p
  FROM orders LEFT JOIN sums USING (o_orderkey))
"""

THRESHOLDS = """
thresholds AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS report_id, o_orderkey,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.01 ELSE CAST(0.1 AS DOUBLE) * CAST(left(o_orderpriority, 1) AS INTEGER) END AS pct,
         CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 20000.0 END AS lim, o_orderkey % 9 <> 0 AS explained
  FROM orders)
"""

ROLL_UP = f"""
WITH {DELTAS},
contexts AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS report_id,
         CASE WHEN c_nationkey % 5 = 0 THEN 'not_checked' WHEN c_nationkey % 7 = 0 THEN 'mismatch' ELSE 'match' END AS context_match,
         c_mktsegment = 'MACHINERY' AND c_acctbal < 0 AS blocker
  FROM customer),
graded AS (
  SELECT o_custkey AS c_custkey, o_orderkey % 2 = 0 AS inside,
         {verdict('d', 'p', '0.9', '300000.0', 'FALSE')} AS verdict
  FROM deltas WHERE b IS NOT NULL),
worst AS (
  SELECT c_custkey,
         max(CASE WHEN inside THEN list_position(['pass','warn','incomplete','block'], verdict) END) AS i,
         max(CASE WHEN NOT inside THEN list_position(['pass','warn','incomplete','block'], verdict) END) AS e,
         bool_or(verdict = 'block') AS any_block
  FROM graded GROUP BY 1),
gaps AS (SELECT o_custkey AS c_custkey, count(*) AS gaps FROM deltas WHERE b IS NULL GROUP BY 1),
joined AS (
  SELECT *, coalesce(['pass','warn','incomplete','block'][i], 'incomplete') AS internal_verdict,
         coalesce(['pass','warn','incomplete','block'][e], CASE WHEN context_match = 'not_checked' THEN 'not_performed' ELSE 'incomplete' END) AS plain
  FROM contexts LEFT JOIN worst USING (c_custkey) LEFT JOIN gaps USING (c_custkey)),
rolled AS (
  SELECT *, CASE WHEN context_match = 'mismatch' THEN 'block'
                 WHEN gaps > 0 AND plain IN ('pass','warn','not_performed') THEN 'incomplete' ELSE plain END AS external_verdict
  FROM joined)
"""

EVENT_CELLS = """
raw AS (
  SELECT 'user-' || user_id AS workbook_id, 'Data!A' || (event_id + 1) AS node, event_id % 10 AS k, event_id, event_type,
         user_id % 3 = 0 AS manual,
         CASE WHEN event_id % 10 IN (0, 1) THEN '=B' || (event_id + 1) || '*2'
              WHEN event_id % 10 = 2 THEN '{=SUM(B1:B2)}' END AS formula
  FROM events WHERE event_id % 10 <> 9)
"""

EVENT_LOG = """
log AS (
  SELECT CAST(user_id AS VARCHAR) AS report_id, event_id AS row_id,
         CASE WHEN event_type = 'purchase' THEN 'state_snapshot' ELSE 'gate_decision' END AS event_type,
         event_type AS action, event_id % 4 + 1 AS gate,
         '{"action":"' || event_type || '","gate":' || (event_id % 4 + 1)
           || CASE WHEN event_id % 8 = 2 THEN ',"acknowledge_incomplete":true'
                   WHEN event_id % 8 = 6 THEN ',"acknowledge_incomplete":false' ELSE '' END || '}' AS payload,
         't' || event_id AS ts,
         CASE WHEN event_id % 5 <> 0 THEN 'Reviewer ' || (event_id % 3) END AS actor
  FROM events)
"""


def chained(partition: str) -> str:
    """Hash chain computed step by step, one row after the other."""
    return f"""WITH RECURSIVE {EVENT_LOG},
numbered AS (
  SELECT report_id, row_id, sha256(payload) AS payload_hash, ts, {partition} AS chain,
         row_number() OVER (PARTITION BY {partition} ORDER BY row_id) AS no FROM log),
chain_rows AS (
  SELECT chain, no, report_id, row_id, payload_hash, repeat('0', 64) AS prev_row_hash,
         sha256(repeat('0', 64) || payload_hash || ts) AS row_hash FROM numbered WHERE no = 1
  UNION ALL
  SELECT n.chain, n.no, n.report_id, n.row_id, n.payload_hash, c.row_hash, sha256(c.row_hash || n.payload_hash || n.ts)
  FROM chain_rows c JOIN numbered n ON n.chain = c.chain AND n.no = c.no + 1)
"""


LITERALS = """
literals AS (
  SELECT wb, 0 AS tab, 'Lines' AS tab_key, 'D' || rn AS cell_ref, rn AS r, 4 AS c, 0 AS pos,
         'Number 0.95 written into a formula' AS description
  FROM kinds JOIN lines USING (k) WHERE returned
  UNION ALL
  SELECT wb, 0, 'Lines', 'B' || (n + 1), n + 1, 2, 0, 'Number 4 written into a formula' FROM kinds WHERE lookup),
conflicts AS (
  SELECT wb, 0 AS tab, 'Lines' AS tab_key, 'A1' AS cell_ref, 0 AS r, 0 AS c, 0 AS pos,
         'Named range ''rate'' differs from tab to tab: Lines=1.1, Summary=1.2' AS description
  FROM kinds WHERE k % 3 = 0),
skipping AS (
  SELECT wb, 0 AS tab, 'Lines' AS tab_key, 'B' || (n + 1) AS cell_ref, n + 1 AS r, 2 AS c, 0 AS pos,
         'A SUM leaves out cells: D2' AS description FROM kinds WHERE skips),
rings AS (
  SELECT wb, 1 AS tab, 'Summary' AS tab_key, 'C1' AS cell_ref, 1 AS r, 0 AS c, 0 AS pos,
         'Cells depend on each other in a ring: Summary!C1 -> Summary!D1 -> Summary!C1' AS description FROM kinds WHERE ring),
found AS (
  SELECT wb, 'warning' AS severity, 2 AS sev, 1 AS det, * EXCLUDE (wb) FROM literals
  UNION ALL SELECT wb, 'blocker', 1, 2, * EXCLUDE (wb) FROM conflicts
  UNION ALL SELECT wb, 'warning', 2, 3, * EXCLUDE (wb) FROM skipping
  UNION ALL SELECT wb, 'blocker', 1, 4, * EXCLUDE (wb) FROM rings),
ids AS (
  SELECT *, 'F' || lpad(CAST(row_number() OVER (PARTITION BY wb ORDER BY sev, det, tab, r, c, pos) AS VARCHAR), 4, '0') AS finding_id
  FROM found)
"""

EDGES = """
edges AS (
  SELECT wb AS workbook_id, 'Lines!D' || rn AS src, 'Lines!B' || rn AS dst FROM kinds JOIN lines USING (k)
  UNION ALL SELECT wb, 'Lines!D' || rn, 'Lines!C' || rn FROM kinds JOIN lines USING (k) WHERE NOT returned
  UNION ALL SELECT wb, 'Lines!B' || (n + 1), 'Lines!D' || rn FROM kinds JOIN lines USING (k)
            WHERE NOT lookup AND NOT (skips AND rn = 2)
  UNION ALL SELECT wb, 'Lines!B' || (n + 1), 'Lines!' || letter || rn FROM kinds JOIN lines USING (k),
            (VALUES ('A'), ('B'), ('C'), ('D')) v(letter) WHERE lookup
  UNION ALL SELECT wb, 'Summary!B1', 'Lines!B' || (n + 1) FROM kinds
  UNION ALL SELECT wb, 'Summary!B1', 'Rates!A1' FROM kinds
  UNION ALL SELECT wb, 'Summary!C1', 'Summary!D1' FROM kinds WHERE ring
  UNION ALL SELECT wb, 'Summary!D1', 'Summary!C1' FROM kinds WHERE ring)
"""

EVENT_FINDINGS = """
found AS (
  SELECT CAST(user_id AS VARCHAR) AS report_id, event_id AS e,
         CASE event_type WHEN 'error' THEN 'blocker' WHEN 'purchase' THEN 'info' ELSE 'warning' END AS severity,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'overridden' WHEN event_id % 3 = 1 THEN 'dismissed' ELSE 'confirmed' END AS decision,
         event_id % 4 = 1 AS explained
  FROM events)
"""

# Mappings and second-pass lines after review: report number mod 4 is the decision.
REVIEWED = LEDGER + """,
proposed AS (
  SELECT o.k, o.wb, l.no, o.ref, o.val, o.lookup, l.amount, l.label, l.account
  FROM outs o JOIN ledger l ON l.k = o.k AND l.no = o.pos + 1),
maps AS (
  SELECT k, wb, 'MAP-000' || no AS mapping_id, no, no AS line_no, ref, 'fuzzy_match' AS suggested_by, k % 4 >= 2 AS approved,
         val, lookup, amount, label, account FROM proposed
  UNION ALL
  SELECT p.k, p.wb, 'MAP-000' || p.no || '-HUMAN', p.no, t.no, p.ref, 'human_direct', TRUE, p.val, p.lookup, t.amount, t.label, t.account
  FROM proposed p JOIN ledger t ON t.k = p.k AND t.no = CASE WHEN p.no = 1 THEN 3 ELSE 1 END
  WHERE p.k % 4 = 0)
"""

D_INT = "abs(src - val)"
D_EXT = "abs(val - amount)"

CASES = """
maps AS (
  SELECT CAST(o_custkey % 100 AS VARCHAR) AS report_id, o_orderkey AS m, o_orderstatus = 'P' AS many, o_orderkey % 50 AS line FROM orders),
one AS (
  SELECT m.report_id, e.event_id AS e, m.m, m.many, m.line,
         CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'error' THEN 'acknowledge_manual' ELSE 'edit' END AS action
  FROM events e LEFT JOIN maps m ON m.m = e.event_id),
ruled AS (
  SELECT *, CASE WHEN action = 'edit' AND e % 6 <> 0 THEN e % 60 END AS target,
         CASE WHEN m IS NULL THEN 'x' || e ELSE CAST(m AS VARCHAR) END AS mapping_id
  FROM (SELECT * FROM one UNION ALL SELECT * FROM one WHERE e % 500 = 0))
"""

DOC_CELLS = f"""
cells AS (
  SELECT lang AS workbook_id, source AS tab_key, source || '!A' || (doc_id + 1) AS node,
         CASE WHEN doc_id % 9 = 0 THEN 'external link path, not sent'
              WHEN doc_id % 4 = 3 THEN 'cell type not allowed by minimization policy, not sent'
              WHEN length(CASE WHEN doc_id % 4 = 1 THEN source ELSE text END) >= 40 THEN 'free text over length threshold, possible PII'
         END AS reason
  FROM documents)
"""

ORACLES = {
    "order_total_reconciliation": f"""WITH {DELTAS}
      SELECT o_orderkey, a AS source_value, round(b, 6) AS target_value, round(d, 6) AS delta, round(p, 6) AS delta_pct,
             {verdict('d', 'p', '0.5', '50000.0', 'b IS NULL')} AS verdict FROM deltas""",
    "signed_control_totals": """WITH sums AS (
        SELECT l_suppkey AS suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS s
        FROM lineitem GROUP BY 1),
      declared AS (
        SELECT s_suppkey AS suppkey, coalesce(s, 0) AS s, CASE WHEN s_suppkey % 11 <> 0 THEN s + CASE WHEN s_suppkey % 7 = 0 THEN 0.01 ELSE 0 END END AS t
        FROM supplier LEFT JOIN sums ON suppkey = s_suppkey)
      SELECT suppkey, CASE WHEN t IS NULL THEN 'not_checked' WHEN s = t THEN 'match' ELSE 'mismatch' END AS status,
             CAST(t AS DOUBLE) AS declared_total, CASE WHEN t IS NOT NULL THEN CAST(s AS DOUBLE) END AS signed_total,
             CAST(s - t AS DOUBLE) AS difference FROM declared""",
    "verdicts_under_thresholds": f"""WITH {DELTAS}, {THRESHOLDS}
      SELECT report_id, {verdict('d', 'p', 'pct', 'lim', 'b IS NULL')} AS verdict, round(pct, 6) AS pct_threshold,
             lim AS absolute_threshold, pct = 0.01 AND lim = 100 AS threshold_is_default, TRUE AS is_final
      FROM deltas JOIN thresholds USING (o_orderkey)""",
    "unexplained_thresholds": f"""WITH {THRESHOLDS}
      SELECT report_id, round(pct, 6) AS pct_threshold, lim AS absolute_threshold FROM thresholds
      WHERE NOT explained AND NOT (pct = 0.01 AND lim = 100)""",
    "context_comparison": """SELECT CAST(c_custkey AS VARCHAR) AS report_id,
        CASE WHEN c_nationkey % 5 = 0 THEN 'not_checked' WHEN c_nationkey % 7 = 0 THEN 'mismatch' ELSE 'match' END AS context_match,
        c_nationkey % 5 <> 0 AND c_acctbal < 0 AS basis_differs FROM customer""",
    "verdict_roll_up": f"""{ROLL_UP}
      SELECT report_id, context_match, internal_verdict, external_verdict,
             CASE WHEN blocker THEN 'block' ELSE ['pass','warn','incomplete','block'][greatest(
               list_position(['pass','warn','incomplete','block'], internal_verdict),
               coalesce(list_position(['pass','warn','incomplete','block'], external_verdict), 1))] END AS overall_verdict,
             CASE WHEN 'block' IN (internal_verdict, external_verdict) THEN 'blocked'
                  WHEN 'incomplete' IN (internal_verdict, external_verdict) AND c_custkey % 2 <> 0 THEN 'needs_acknowledgement'
                  ELSE 'open' END AS gate_status FROM rolled""",
    "report_flags": f"""{ROLL_UP}
      SELECT report_id, 'block' IN (internal_verdict, external_verdict) OR coalesce(any_block, FALSE) AS has_blocker,
             'incomplete' IN (internal_verdict, external_verdict) AS is_incomplete FROM rolled""",
    "population_gaps": """
      SELECT 'order' AS side, o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F'
        AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')
      UNION ALL
      SELECT DISTINCT 'item', l_orderkey FROM lineitem WHERE l_returnflag = 'A'
        AND NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND o_orderstatus = 'F')""",
    "corpus_cells": f"""WITH {ROWS}
      SELECT wb AS workbook_id, CAST(4 * n + 6 + CASE WHEN ring THEN 2 ELSE 0 END AS BIGINT) AS cells,
             CAST(n + 2 + CASE WHEN ring THEN 2 ELSE 0 END AS BIGINT) AS formulas,
             CAST(n + 2 AS BIGINT) AS texts, n + 1 AS last_row FROM kinds""",
    "damaged_workbooks": f"""WITH {ROWS}
      SELECT wb AS file, CASE WHEN k % 7 IN (3, 5) THEN 'BadZipFile' END AS kind,
             CASE WHEN k % 7 IN (3, 5) THEN 0 ELSE CAST(4 * n + 6 + CASE WHEN ring THEN 2 ELSE 0 END AS BIGINT) END AS cells,
             CASE WHEN k % 7 IN (3, 5) THEN 0 ELSE CAST(n + 2 + CASE WHEN ring THEN 2 ELSE 0 END AS BIGINT) END AS formulas
      FROM kinds""",
    "workbook_ingest": f"""WITH {VALUES}
      SELECT wb AS file, 'Lines!A' || rn AS node, CAST(NULL AS VARCHAR) AS formula, 'text' AS data_type, CAST(NULL AS DOUBLE) AS value_num FROM kinds JOIN lines USING (k)
      UNION ALL SELECT wb, 'Lines!B' || rn, NULL, 'number', price FROM kinds JOIN lines USING (k)
      UNION ALL SELECT wb, 'Lines!C' || rn, NULL, 'number', discount FROM kinds JOIN lines USING (k)
      UNION ALL SELECT wb, 'Lines!D' || rn, CASE WHEN nets.returned THEN '=B' || rn || '*0.95' ELSE '=B' || rn || '*(1-C' || rn || ')' END,
                       'number', round(net, 6) FROM kinds JOIN nets USING (k)
      UNION ALL SELECT wb, 'Lines!A' || (n + 1), NULL, 'text', NULL FROM kinds
      UNION ALL SELECT wb, 'Lines!B' || (n + 1), CASE WHEN lookup THEN '=VLOOKUP(A1,A1:D' || n || ',4)' WHEN skips THEN '=SUM(D1:D1,D3:D' || n || ')'
                       ELSE '=SUM(D1:D' || n || ')' END, 'number', total FROM kinds
      UNION ALL SELECT wb, 'Summary!A1', NULL, 'text', NULL FROM kinds
      UNION ALL SELECT wb, 'Summary!B1', '=Lines!B' || (n + 1) || '*Rates!A1', 'number', round(total * 1.1, 6) FROM kinds
      UNION ALL SELECT wb, 'Summary!C1', '=Summary!D1+1', 'number', 0 FROM kinds WHERE ring
      UNION ALL SELECT wb, 'Summary!D1', '=C1-1', 'number', 0 FROM kinds WHERE ring
      UNION ALL SELECT wb, 'Rates!A1', NULL, 'number', 1.1 FROM kinds
      UNION ALL SELECT wb, 'Rates!A2', NULL, 'number', CASE WHEN k % 3 = 0 THEN 1.2 ELSE 1.1 END FROM kinds""",
    "cell_classification": f"""WITH {EVENT_CELLS}
      SELECT workbook_id, node, formula,
             CASE WHEN k = 0 THEN 'blank' WHEN k IN (1, 2, 3) THEN 'number' WHEN k = 4 THEN 'boolean' WHEN k = 5 THEN 'date'
                  WHEN k = 6 THEN 'error' ELSE 'text' END AS data_type,
             CASE WHEN k = 3 THEN '0.00' ELSE 'General' END AS number_format, k = 6 AS is_error,
             CASE WHEN k = 6 THEN '#DIV/0!' END AS error_type, formula IS NOT NULL AND (k = 0 OR manual) AS is_stale FROM raw""",
    "cell_warnings": f"""WITH {EVENT_CELLS}
      SELECT workbook_id, CASE k WHEN 0 THEN 'never_calculated' WHEN 2 THEN 'array_formula' WHEN 6 THEN 'formula_error' ELSE 'number_as_text' END AS kind,
             node AS subject, node || ': ' || CASE k WHEN 0 THEN 'formula whose result was never stored'
               WHEN 2 THEN 'array formula' WHEN 6 THEN 'formula error #DIV/0!'
               ELSE 'digits kept as text (''1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ''')' END AS message
      FROM raw WHERE k IN (0, 2, 6, 7)""",
    "stale_cells": f"""WITH {EVENT_CELLS} SELECT workbook_id, node FROM raw WHERE formula IS NOT NULL AND (k = 0 OR manual)""",
    "tab_name_warnings": """WITH tabs AS (
        SELECT 'nation-' || c_nationkey AS workbook_id, c_custkey AS i, c_mktsegment AS seg,
               CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) || ' ' ELSE c_mktsegment END AS name FROM customer),
      keyed AS (
        SELECT *, row_number() OVER (PARTITION BY workbook_id, name ORDER BY i) - 1 AS nth,
               first_value(name) OVER (PARTITION BY workbook_id, seg ORDER BY i) AS first_name FROM tabs)
      SELECT workbook_id, 'duplicate_tab' AS kind, name || '_' || nth AS subject,
             'duplicate tab name ''' || name || ''' renamed to ''' || name || '_' || nth || ''' for cell-key purposes' AS message
      FROM keyed WHERE nth > 0
      UNION ALL
      SELECT workbook_id, 'alike_tabs', name, 'tab names ''' || first_name || ''' and ''' || name || ''' look like duplicates'
      FROM keyed WHERE first_name <> name""",
    "cell_references": f"""WITH {ROWS}
      SELECT wb AS workbook_id, 'Lines!D' || rn AS src, CAST(CASE WHEN returned THEN 1 ELSE 2 END AS BIGINT) AS refs,
             CAST(0 AS BIGINT) AS ranges, CAST(CASE WHEN returned THEN 1 ELSE 2 END AS BIGINT) AS area, CAST(0 AS BIGINT) AS other_tab
      FROM kinds JOIN lines USING (k)
      UNION ALL SELECT wb, 'Lines!B' || (n + 1), CASE WHEN lookup OR skips THEN 2 ELSE 1 END, CASE WHEN skips THEN 2 ELSE 1 END,
             CASE WHEN lookup THEN 4 * n + 1 WHEN skips THEN n - 1 ELSE n END, 0 FROM kinds
      UNION ALL SELECT wb, 'Summary!B1', 2, 0, 2, 2 FROM kinds
      UNION ALL SELECT wb, s, 1, 0, 1, 0 FROM kinds, (VALUES ('Summary!C1'), ('Summary!D1')) v(s) WHERE ring""",
    "cell_edges": f"WITH {ROWS}, {EDGES} SELECT * FROM edges",
    "tab_edges": f"""WITH {ROWS} SELECT wb AS workbook_id, 'Summary' AS src, d AS dst FROM kinds, (VALUES ('Lines'), ('Rates')) v(d)""",
    "output_candidates": f"""WITH {ROWS}
      SELECT wb AS workbook_id, 'Lines' AS tab_key, CAST(3 * n + 1 AS BIGINT) AS candidates, CAST(n + 1 AS BIGINT) AS formulas FROM kinds
      UNION ALL SELECT wb, 'Summary', CASE WHEN ring THEN 3 ELSE 1 END, CASE WHEN ring THEN 3 ELSE 1 END FROM kinds
      UNION ALL SELECT wb, 'Rates', 2, 0 FROM kinds""",
    "output_labels": f"WITH {VALUES} SELECT wb AS workbook_id, ref AS output_ref, label FROM outs",
    "large_range_total": """WITH rows AS (
        SELECT o_orderkey * 3 // 1000000 AS part, o_orderkey * 3 % 1000000 + 1 AS r, o_totalprice AS v FROM orders),
      books AS (
        SELECT part, last, note, sum(CASE WHEN r <= last THEN v ELSE 0 END) + sum(CASE WHEN r <= 3 THEN v ELSE 0 END) AS total
        FROM rows, (VALUES (4999), (5000), (5001), (1000000)) s(last), (VALUES (TRUE), (FALSE)) k(note) GROUP BY ALL)
      SELECT 'orders-' || part || '-' || last || CASE WHEN note THEN '-note' ELSE '-plain' END AS workbook_id, 'Book!C1' AS root,
             CAST(last + 1 AS BIGINT) AS chain_nodes, CAST(CASE WHEN note THEN last ELSE last + 1 END AS BIGINT) AS supported_nodes,
             round(CASE WHEN note THEN 100.0 * last / (last + 1) ELSE 100.0 END, 6) AS coverage_pct,
             CASE WHEN NOT note THEN round(total, 2) END AS value FROM books""",
    "running_balances": """SELECT 'customer-' || o_custkey AS workbook_id, 'Book!B' || count(*) AS root,
             2 * count(*) AS chain_nodes, 100.0 AS coverage_pct, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_custkey""",
    "shared_cycles": """WITH s AS (
        SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS no,
               count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
      SELECT 'nation-' || k AS workbook_id, CAST(place AS INTEGER) AS place,
             string_agg('S' || lpad(CAST(no AS VARCHAR), 7, '0'), ' ' ORDER BY no) AS members, count(*) AS size
      FROM s, (VALUES (1), (2)) p(place) WHERE place = 1 OR (no != 2 AND n >= 3) GROUP BY k, place""",
    "part_tree_reach": """WITH RECURSIVE walk AS (
        SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part
        UNION SELECT root, node // 2, depth + 1 FROM walk WHERE node > 0)
      SELECT CAST(root AS VARCHAR) AS root, CAST(node AS VARCHAR) AS node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2""",
    "cycle_nodes": "SELECT CAST(s_suppkey AS VARCHAR) AS node FROM supplier WHERE s_nationkey % 2 = 0",
    "cycle_lengths": """SELECT min(CAST(s_suppkey AS VARCHAR)) AS first_member, count(*) AS members FROM supplier
      WHERE s_nationkey % 2 = 0 GROUP BY s_nationkey""",
    "buried_literals": f"WITH {ROWS}, {LITERALS} SELECT wb AS workbook_id, tab_key, cell_ref, description FROM literals",
    "conflicting_names": f"WITH {ROWS}, {LITERALS} SELECT wb AS workbook_id, tab_key, cell_ref, description FROM conflicts",
    "skipped_rows": f"WITH {ROWS}, {LITERALS} SELECT wb AS workbook_id, tab_key, cell_ref, description FROM skipping",
    "circular_references": f"WITH {ROWS}, {LITERALS} SELECT wb AS workbook_id, tab_key, cell_ref, description FROM rings",
    "all_findings": f"WITH {ROWS}, {LITERALS} SELECT wb AS workbook_id, finding_id, severity, tab_key, cell_ref, description FROM ids",
    "finding_cells": f"""WITH {ROWS}, {LITERALS}, {EDGES},
      fan AS (SELECT workbook_id, src, count(*) AS c FROM edges GROUP BY ALL)
      SELECT wb AS workbook_id, finding_id, tab_key || '!' || cell_ref AS node, coalesce(fan.c, 0) AS depends_on
      FROM ids LEFT JOIN fan ON fan.workbook_id = wb AND src = tab_key || '!' || cell_ref""",
    "undecided_findings": f"""WITH {EVENT_FINDINGS}
      SELECT report_id, CAST(e AS VARCHAR) AS finding_id, severity, CASE WHEN decision IS NULL THEN 'no decision' ELSE 'no reason' END AS problem
      FROM found WHERE decision IS NULL OR (decision <> 'confirmed' AND NOT explained)""",
    "finding_counts": f"""WITH {EVENT_FINDINGS}
      SELECT report_id, count(*) AS findings, count(*) FILTER (severity = 'blocker') AS blockers,
             count(*) FILTER (severity = 'blocker' AND decision IN ('overridden', 'dismissed')) AS blockers_resolved,
             count(decision) AS decided, coalesce(bool_or(severity = 'blocker' AND decision = 'confirmed'), FALSE) AS has_confirmed_blocker
      FROM found GROUP BY 1""",
    "derivation_chains": f"""WITH {VALUES}
      SELECT wb AS workbook_id, ref AS root, CAST(nodes AS BIGINT) AS chain_nodes, CAST(good AS BIGINT) AS supported_nodes,
             round(100.0 * good / nodes, 6) AS coverage_pct, round(val, 6) AS value FROM outs""",
    "derivation_steps": f"""WITH {VALUES},
      per AS (SELECT wb, n, k.k, lookup, count(*) FILTER (NOT (skips AND rn = 2)) AS d,
                     sum(CASE WHEN skips AND rn = 2 THEN 0 WHEN returned THEN 1 ELSE 2 END) AS leaves
              FROM kinds k JOIN lines USING (k) GROUP BY ALL)
      SELECT wb AS workbook_id, 'Lines!B' || (n + 1) AS root_ref, CASE WHEN lookup THEN 0 ELSE 2 END AS depth,
             CAST(CASE WHEN lookup THEN 1 ELSE 1 + d END AS BIGINT) AS formulas,
             CAST(CASE WHEN lookup THEN 4 * n ELSE d + leaves END AS BIGINT) AS depends_on,
             CAST(CASE WHEN lookup THEN 1 ELSE 0 END AS BIGINT) AS unsupported FROM per
      UNION ALL
      SELECT wb, 'Summary!B1', CASE WHEN lookup THEN 1 ELSE 3 END, CASE WHEN lookup THEN 2 ELSE 2 + d END,
             CAST(2 + CASE WHEN lookup THEN 4 * n ELSE d + leaves END AS BIGINT), CASE WHEN lookup THEN 1 ELSE 0 END FROM per""",
    "internal_reconciliation": f"""WITH {VALUES}
      SELECT wb AS report_id, ref AS output_ref, label, round(src, 6) AS source_value, round(val, 6) AS target_value,
             round({D_INT}, 6) AS delta, {verdict(D_INT, share('src', 'val'), '0.01', '100.0', 'lookup')} AS verdict,
             CASE WHEN lookup THEN 'partial' ELSE 'complete' END AS completeness, round(100.0 * good / nodes, 6) AS coverage_pct,
             CAST(nodes - good AS BIGINT) AS unsupported_count FROM outs""",
    "unreconstructed_shares": f"""WITH {VALUES}
      SELECT wb AS report_id, round(avg(100 - round(100.0 * good / nodes, 6)), 4) AS incomplete_pct FROM outs WHERE lookup GROUP BY wb""",
    "cells_by_reference": f"""WITH {ROWS},
      refs AS (
        SELECT wb, 'Lines' AS tab, unnest(['A', 'B', 'C', 'D']) || rn AS ref FROM kinds JOIN lines USING (k)
        UNION ALL SELECT wb, 'Lines', unnest(['A', 'B']) || (n + 1) FROM kinds
        UNION ALL SELECT wb, 'Summary', unnest(['A1', 'B1']) FROM kinds
        UNION ALL SELECT wb, 'Summary', unnest(['C1', 'D1']) FROM kinds WHERE ring
        UNION ALL SELECT wb, 'Rates', unnest(['A1', 'A2']) FROM kinds)
      SELECT wb AS workbook_id, tab AS tab_key, ref AS cell_ref, row_number() OVER (PARTITION BY wb, tab ORDER BY ref) AS position FROM refs""",
    "label_mappings": f"""WITH {VALUES}
      SELECT wb AS report_id, 'MAP-000' || (pos + 1) AS mapping_id, ref AS output_ref, 'REF-000' || (pos + 1) AS line_id,
             'one_to_one' AS mapping_type, CASE WHEN pos = 0 THEN 95.65 ELSE 96.3 END AS suggested_confidence, FALSE AS is_approved FROM outs""",
    "external_reconciliation": f"""WITH {LEDGER}
      SELECT o.wb AS report_id, 'MAP-000' || no AS mapping_id, l.label || ' (REF-000' || no || ')' AS label,
             round(val, 6) AS source_value, round(amount, 6) AS target_value, round({D_EXT}, 6) AS delta,
             {verdict(D_EXT, share('val', 'amount'), '0.01', '100.0', 'lookup')} AS verdict,
             CASE WHEN lookup THEN 'partial' ELSE 'complete' END AS completeness
      FROM outs o JOIN ledger l ON l.k = o.k AND no = pos + 1""",
    "unmatched_ledger_lines": f"""WITH {LEDGER} SELECT wb AS report_id, 'REF-000' || no AS item FROM ledger WHERE no > 2""",
    "reviewed_mappings": f"""WITH {REVIEWED}
      SELECT wb AS report_id, mapping_id, 'REF-000' || line_no AS line_id, ref AS output_ref, suggested_by,
             CASE WHEN approved THEN 'Reviewer A' END AS approved_by, approved AS is_approved FROM maps""",
    "reviewed_lines": f"""WITH {REVIEWED}
      SELECT wb AS report_id, mapping_id, label || ' (REF-000' || line_no || ')' AS label, round(amount, 6) AS target_value,
             round({D_EXT}, 6) AS delta, {verdict(D_EXT, share('val', 'amount'), '0.01', '100.0', 'lookup')} AS verdict,
             TRUE AS is_final FROM maps WHERE approved""",
    "mapping_report": f"""WITH {REVIEWED}
      SELECT wb AS report_id, mapping_id, CASE WHEN approved THEN label || ' (REF-000' || line_no || ')' ELSE ref END AS label,
             account AS account_number, round(amount, 6) AS accounts_value,
             CASE WHEN approved THEN {verdict(D_EXT, share('val', 'amount'), '0.01', '100.0', 'lookup')} ELSE 'incomplete' END AS verdict,
             'general ledger' AS source_label, approved AS is_approved FROM maps""",
    "report_summary": f"""WITH {REVIEWED},
      graded AS (
        SELECT wb, 'i' AS pass, {verdict(D_INT, share('src', 'val'), '0.01', '100.0', 'lookup')} AS v FROM outs
        UNION ALL
        SELECT wb, 'e', {verdict(D_EXT, share('val', 'amount'), '0.01', '100.0', 'lookup')} FROM maps WHERE approved),
      worst AS (
        SELECT wb, max(CASE WHEN pass = 'i' THEN list_position(['pass','warn','incomplete','block'], v) END) AS i,
               max(CASE WHEN pass = 'e' THEN list_position(['pass','warn','incomplete','block'], v) END) AS e,
               count(*) FILTER (pass = 'i') AS internal_lines, count(*) FILTER (pass = 'e') AS external_lines
        FROM graded GROUP BY 1),
      gap AS (
        SELECT h.wb,
          (SELECT count(*) FROM ledger l WHERE l.k = h.k AND NOT EXISTS (SELECT 1 FROM maps m WHERE m.k = h.k AND m.approved AND m.line_no = l.no))
          + CASE WHEN h.k % 4 = 1 THEN 2 ELSE 0 END AS gaps FROM heads h),
      counted AS (SELECT wb, count(*) AS mappings, count(*) FILTER (approved) AS approved_mappings FROM maps GROUP BY 1),
      ext AS (
        SELECT *, CASE WHEN coalesce(e, 3) <= 2 AND gaps > 0 THEN 3 ELSE coalesce(e, 3) END AS x
        FROM worst JOIN gap USING (wb) JOIN counted USING (wb))
      SELECT wb AS report_id, gaps, ['pass','warn','incomplete','block'][i] AS internal_verdict,
             ['pass','warn','incomplete','block'][x] AS external_verdict,
             ['pass','warn','incomplete','block'][greatest(i, x)] AS overall_verdict,
             internal_lines, external_lines, mappings, approved_mappings FROM ext""",
    "mapping_sections": f"""WITH {REVIEWED}
      SELECT wb AS report_id, CASE WHEN approved THEN 'approved' ELSE 'proposed' END AS section, mapping_id, account AS account_number FROM maps
      UNION ALL SELECT wb, 'manual', mapping_id, account FROM maps WHERE k % 7 = 0 AND mapping_id LIKE 'MAP-0001%'""",
    "trace_index": f"""WITH {REVIEWED}
      SELECT wb AS report_id, 1 AS section, ref AS figure_key, round(coalesce(val, src), 6) AS report_value, ref AS root_ref,
             CASE WHEN lookup THEN 'partially_traced' ELSE 'traced' END AS trace_status, CAST(NULL AS VARCHAR) AS account_number FROM outs
      UNION ALL SELECT wb, 2, mapping_id, round(amount, 6), ref, 'traced', account FROM maps WHERE approved
      UNION ALL SELECT wb, 3, 'REF-000' || no, round(amount, 6), NULL, 'unmapped', NULL FROM ledger l
        WHERE NOT EXISTS (SELECT 1 FROM maps m WHERE m.k = l.k AND m.approved AND m.line_no = l.no)
      UNION ALL SELECT wb, 4, 'F0001', NULL, 'Lines!B' || (n + 1), 'traced', NULL FROM kinds WHERE skips""",
    "review_errors": f"""WITH {CASES},
      edits AS (SELECT * FROM ruled WHERE m IS NOT NULL AND action = 'edit' AND NOT many),
      problems AS (
        SELECT 'more than one decision' AS problem, mapping_id FROM (SELECT report_id, mapping_id FROM ruled GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'unknown mapping', mapping_id FROM (SELECT DISTINCT mapping_id FROM ruled WHERE m IS NULL)
        UNION ALL SELECT 'replacement given if and only if action is edit', mapping_id FROM ruled WHERE (action = 'edit') <> (target IS NOT NULL)
        UNION ALL SELECT 'action does not fit the mapping type', mapping_id FROM ruled WHERE m IS NOT NULL AND (NOT many) = (action = 'acknowledge_manual')
        UNION ALL SELECT 'replacement is the current line', mapping_id FROM edits WHERE target = line
        UNION ALL SELECT 'replacement line does not exist', mapping_id FROM edits WHERE target IS NULL OR target >= 50
        UNION ALL SELECT 'duplicate_target', mapping_id FROM (SELECT *, count(*) OVER (PARTITION BY report_id, coalesce(target, -1)) AS c FROM edits) WHERE c > 1
        UNION ALL SELECT 'no decision', CAST(m AS VARCHAR) FROM maps WHERE m NOT IN (SELECT m FROM ruled WHERE m IS NOT NULL))
      SELECT problem, count(*) AS rows, count(DISTINCT mapping_id) AS mappings FROM problems GROUP BY 1""",
    "unreviewed_mappings": f"""WITH {CASES}
      SELECT report_id, CAST(m AS VARCHAR) AS mapping_id FROM maps WHERE m NOT IN (SELECT m FROM ruled WHERE m IS NOT NULL)""",
    "mapping_violations": """SELECT CAST(o_custkey AS VARCHAR) AS report_id, CAST(o_orderkey AS VARCHAR) AS label,
        CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS mapping_id,
        CASE WHEN o_orderkey % 10 = 0 THEN 'no mapping_id' WHEN o_orderkey % 7 = 0 THEN 'mapping not in result' ELSE 'mapping not approved' END AS problem
      FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 OR o_orderstatus <> 'F'""",
    "output_errors": f"""WITH {ROWS}
      SELECT wb AS report_id, 'Lines!E' || n AS output_ref, 'does not exist in the workbook' AS problem FROM kinds WHERE k % 8 = 0
      UNION ALL SELECT 'wb-' || o_orderkey, NULL, 'the report names no output' FROM orders
      WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "ledger_lines": """SELECT CAST(o_custkey AS VARCHAR) AS report_id, 'REF-' || lpad(CAST(o_orderkey + 1 AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey + 1 AS VARCHAR))) AS INTEGER), '0') AS line_id,
        o_orderstatus || '-account' AS account_number, o_orderpriority AS label, 'EUR' AS currency, 'Not supplied' AS ledger_source,
        CASE WHEN o_orderkey % 2 = 0 THEN 'debit' ELSE 'credit' END AS debit_credit, o_totalprice AS amount
      FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0
        AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0""",
    "ledger_row_errors": """WITH judged AS (
        SELECT CAST(o_custkey AS VARCHAR) AS report_id, o_orderkey + 1 AS row_no,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'the label is empty'
               WHEN o_orderkey % 19 = 0 THEN 'the account number is empty'
               WHEN o_orderkey % 43 = 0 THEN 'neither debit nor credit'
               WHEN o_orderkey % 29 = 0 THEN 'the amount is negative or not finite'
               WHEN o_orderkey % 31 = 0 THEN 'the amount is no number'
               WHEN o_orderkey % 37 = 0 THEN 'the amount is negative or not finite'
               WHEN o_orderkey % 41 = 0 THEN 'the amount is empty' END AS problem FROM orders)
      SELECT report_id, row_no, 'Row ' || row_no || ': ' || problem AS message FROM judged WHERE problem IS NOT NULL""",
    "extract_errors": """WITH usable AS (
        SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0
        AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0)
      SELECT CAST(c_custkey AS VARCHAR) AS report_id, 'not given: source label' AS message FROM customer WHERE c_custkey % 50 = 0
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'control total confirmed but not given' FROM customer
        WHERE c_custkey % 20 = 0 AND c_custkey % 3 <> 0
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'the extract has no complete row' FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM usable)""",
    "file_identity": """SELECT CAST(doc_id AS VARCHAR) AS report_id, source AS filename,
        CASE WHEN doc_id % 10 = 0 THEN repeat('0', 64) WHEN doc_id % 10 = 1 THEN 'not_yet_parsed' ELSE sha256(text) END AS confirmed_workbook_hash,
        sha256(text) AS observed_workbook_hash, doc_id % 10 > 1 AS is_match FROM documents""",
    "disclosure_decisions": f"""WITH {DOC_CELLS},
      asked AS (SELECT DISTINCT workbook_id, tab_key AS request_tab FROM cells),
      judged AS (
        SELECT workbook_id, request_tab, node,
               CASE WHEN tab_key <> request_tab THEN 'not reachable from this tab or its designated outputs, not sent' ELSE reason END AS reason
        FROM cells JOIN asked USING (workbook_id))
      SELECT *, reason IS NULL AS included FROM judged""",
    "disclosure_manifest": f"""WITH {DOC_CELLS},
      per AS (
        SELECT workbook_id, tab_key, count(*) AS scoped, count(*) FILTER (reason IS NULL) AS included,
               count(*) FILTER (reason LIKE 'external%') AS external_link, count(*) FILTER (reason LIKE 'free%') AS free_text,
               count(*) FILTER (reason LIKE 'cell type%') AS type_not_allowed FROM cells GROUP BY 1, 2),
      totals AS (SELECT workbook_id, count(*) AS c FROM cells GROUP BY 1)
      SELECT workbook_id, tab_key, included, c - included AS excluded, c - scoped AS out_of_scope, external_link, free_text, type_not_allowed
      FROM per JOIN totals USING (workbook_id)""",
    "workbook_disclosure": f"""WITH {ROWS}, sized AS (
        SELECT wb, n, ring, lookup, 4 * n + 6 + CASE WHEN ring THEN 2 ELSE 0 END AS cells,
               -- cells below the total: all lines for a lookup, else formulas and their inputs
               CASE WHEN lookup THEN 4 * n ELSE sum(CASE WHEN skips AND rn = 2 THEN 0 WHEN returned THEN 2 ELSE 3 END) END AS below
        FROM kinds JOIN lines USING (k) GROUP BY wb, n, ring, lookup),
      scoped AS (
        SELECT wb, cells, 'Summary' AS tab_key, below + 2 + 2 + CASE WHEN ring THEN 2 ELSE 0 END AS inside FROM sized
        UNION ALL SELECT wb, cells, 'Rates', below + 2 + 2 FROM sized)
      SELECT wb AS workbook_id, tab_key, CAST(inside AS BIGINT) AS included, CAST(cells - inside AS BIGINT) AS excluded,
             CAST(cells - inside AS BIGINT) AS out_of_scope FROM scoped""",
    "names_for_tabs": f"""WITH {ROWS} SELECT wb AS workbook_id, t AS tab_key, m AS name FROM kinds,
      (VALUES ('Lines', 'rate'), ('Lines', 'first_item'), ('Summary', 'rate'), ('Rates', 'rate'), ('Rates', 'rate')) v(t, m)""",
    "log_append": chained("report_id") + "SELECT report_id, row_id, payload_hash, prev_row_hash, row_hash FROM chain_rows",
    "log_append_single_chain": chained("0") + "SELECT row_id, prev_row_hash, row_hash FROM chain_rows",
    "gate_events": f"""WITH {EVENT_FINDINGS}, {CASES},
      ctx AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'not_checked' WHEN c_nationkey % 7 = 0 THEN 'mismatch' ELSE 'match' END AS m, c_custkey FROM customer),
      acts AS (SELECT DISTINCT report_id, mapping_id, many, action, target FROM ruled WHERE m IS NOT NULL)
      SELECT 'gate_decision' AS event_type, '1' AS gate, 'context_confirmed' AS action, m AS context_match, count(*) AS events, count(*) AS reports FROM ctx GROUP BY m
      UNION ALL SELECT 'gate_decision', '2', 'findings_reviewed_and_outputs_designated', '-', sum(parts)::BIGINT, count(*)
        FROM (SELECT report_id, (count(*) + 999) // 1000 AS parts FROM found WHERE decision IS NOT NULL GROUP BY 1)
      UNION ALL SELECT 'mapping_decision', '-', CASE WHEN many THEN 'acknowledged_manual_reconciliation' WHEN action = 'approve' THEN 'approved'
          WHEN action = 'reject' THEN 'rejected' ELSE 'replaced_with_human_direct_mapping' END, '-', count(*), count(DISTINCT report_id) FROM acts GROUP BY 3""",
    "log_verification": f"""WITH {EVENT_LOG},
      linked AS (SELECT *, lag(row_id) OVER (PARTITION BY report_id ORDER BY row_id) AS before FROM log)
      SELECT report_id, row_id, CASE WHEN row_id % 97 = 0 THEN 'payload' ELSE 'link' END AS problem FROM linked
      WHERE row_id % 101 <> 0 AND (row_id % 97 = 0 OR before % 101 = 0)""",
    "single_chain_verification": f"""WITH {EVENT_LOG}
      SELECT report_id, row_id, CASE WHEN row_id % 97 = 0 THEN 'payload' ELSE 'link' END AS problem FROM log
      WHERE row_id % 101 <> 0 AND (row_id % 97 = 0 OR row_id % 101 = 1)""",
    "audit_events": f"""WITH {EVENT_LOG}
      SELECT report_id, row_id, event_type, CASE WHEN row_id % 50 = 0 THEN '-' ELSE CAST(gate AS VARCHAR) END AS gate,
             CASE WHEN row_id % 50 = 0 THEN '-' ELSE action END AS action, coalesce(actor, '-') AS actor, ts,
             left(sha256(payload), 12) AS short_hash FROM log""",
    "acknowledgements": f"""WITH {EVENT_LOG}
      SELECT report_id, max(row_id) % 8 = 2 AS acknowledge_incomplete FROM log WHERE row_id % 4 = 2 GROUP BY 1""",
    "event_errors": """SELECT CAST(user_id AS VARCHAR) AS report_id, event_id AS row_id,
        CASE WHEN event_id % 11 = 0 THEN 'workbook_hash is missing' WHEN event_id % 13 = 0 THEN 'code_version is missing'
             ELSE 'the key ''context'' is taken for the log''s own use' END AS problem
      FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 7 = 0""",
    "independence_statements": f"""WITH {EVENT_LOG},
      kept AS (SELECT report_id, event_type, gate, CASE WHEN CAST(report_id AS INTEGER) % 2 = 0 THEN ' reviewer 1' ELSE 'Reviewer B' END AS name,
                      CASE WHEN CAST(report_id AS INTEGER) % 3 <> 0 OR actor <> 'Reviewer 0' THEN actor END AS who FROM log),
      prepared AS (SELECT report_id, string_agg(DISTINCT who, ', ' ORDER BY who) AS preparers, bool_and(lower(who) = lower(trim(name))) AS same_person
                   FROM kept WHERE event_type = 'gate_decision' AND gate IN (2, 3) AND who IS NOT NULL GROUP BY 1)
      SELECT r.report_id, CAST(r.report_id AS INTEGER) % 2 = 0 AS name_in_registry, preparers, same_person
      FROM (SELECT DISTINCT report_id FROM kept) r LEFT JOIN prepared USING (report_id)""",
    "latest_snapshots": """SELECT CAST(user_id AS VARCHAR) AS report_id, event_type AS gate_name, max(event_id) AS snapshot_id,
        sha256(arg_max(props, event_id)) AS state_hash FROM events GROUP BY 1, 2""",
    "recovery_status": """WITH last AS (
        SELECT CAST(user_id AS VARCHAR) AS report_id, user_id, max(event_id) AS e, arg_max(event_type, event_id) AS gate_name,
               arg_max(props, event_id) AS state,
               coalesce(bool_or(event_id % 6 <> 0 AND user_id % 10 = 0 AND event_id % 25 = 1), FALSE) AS bad FROM events GROUP BY 1, 2)
      SELECT report_id, gate_name, e AS snapshot_id,
        CASE WHEN bad THEN 'chain_broken' WHEN e % 4 = 1 THEN 'content_mismatch'
             WHEN NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 6 <> 0 AND x.user_id = last.user_id AND x.event_type = gate_name AND x.props = state)
             THEN 'no_commitment' ELSE 'recoverable' END AS recovery_status FROM last""",
}
