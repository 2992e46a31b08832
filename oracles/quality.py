"""SQL for the data-quality queries."""

from oracles.base import sql

EXTRA = {
    "fr": "SELECT cik, report_date, accession, form, n_positions, round(total_value, 2) AS v FROM f_resolved",
    "adj": """SELECT *, lag(v) OVER w AS pv, lag(report_date) OVER w AS pq, lead(v) OVER w AS nv, lead(report_date) OVER w AS nq
 FROM fr WINDOW w AS (PARTITION BY cik ORDER BY report_date)""",
    "jumps": """SELECT cik, pq AS prev_report_date, report_date, greatest(v / pv, pv / v) AS ratio,
  CASE WHEN v > pv THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN greatest(v / pv, pv / v) >= 1000 THEN 'critical' WHEN greatest(v / pv, pv / v) >= 250 THEN 'high' ELSE 'review' END AS severity
 FROM adj WHERE pv > 0 AND v > 0 AND greatest(v / pv, pv / v) >= 100""",
    "units": """SELECT cik, report_date, nq AS next_report_date, greatest(pv / nv, nv / pv) AS neighbor_ratio, v / sqrt(pv * nv) AS g,
  CASE WHEN v < sqrt(pv * nv) THEN 'MULTIPLY_1000' ELSE 'DIVIDE_1000' END AS action
 FROM adj WHERE pv > 0 AND v > 0 AND nv > 0 AND greatest(pv / nv, nv / pv) <= 5
  AND (v / sqrt(pv * nv) BETWEEN 1 / 1200.0::DOUBLE AND 1 / 800.0::DOUBLE OR v / sqrt(pv * nv) BETWEEN 800 AND 1200)""",
    "latest": "SELECT cik, max(report_date) AS q FROM fr GROUP BY cik",
    "sq": """SELECT coalesce(max(q) FILTER (n >= least(5, greatest(1, ceil(0.1 * (SELECT count(*) FROM latest))))), max(q)) AS q
 FROM (SELECT q, count(*) AS n FROM latest GROUP BY q)""",
    "calendar": "SELECT report_date AS q, row_number() OVER (ORDER BY report_date) AS i FROM (SELECT DISTINCT report_date FROM fr)",
    "stale": """SELECT f.cik, f.label, (SELECT q FROM sq) AS latest_dataset_quarter, l.q AS latest_fund_quarter,
  CASE WHEN l.q IS NULL THEN (SELECT count(*) FROM calendar) ELSE (SELECT i FROM calendar WHERE q = (SELECT q FROM sq)) - c.i END AS quarters_behind
 FROM f_funds f LEFT JOIN latest l USING (cik) LEFT JOIN calendar c ON c.q = l.q
 WHERE l.q IS NULL OR l.q < (SELECT q FROM sq)""",
    "dup": """SELECT *, count(*) OVER (PARTITION BY normalized_label) AS n_funds FROM (
  SELECT *, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS normalized_label FROM f_funds)
 QUALIFY count(*) OVER (PARTITION BY normalized_label) > 1""",
    "found": """SELECT kind, cik, event_quarter, size, detail, CASE WHEN kind IN ('stale_fund', 'duplicate_label') THEN 'current_quarter'
   WHEN event_quarter = (SELECT q FROM sq) THEN 'current_quarter' WHEN event_quarter < (SELECT q FROM sq) THEN 'historical' ELSE 'outside_current_quarter' END AS temporal_scope
 FROM (SELECT 'aum_jump' AS kind, cik, report_date AS event_quarter, ratio AS size, severity AS detail FROM jumps
  UNION ALL SELECT 'unit_scale_candidate', cik, next_report_date, g, action FROM units
  UNION ALL SELECT 'stale_fund', cik, latest_fund_quarter, quarters_behind, '' FROM stale
  UNION ALL SELECT 'duplicate_label', cik, NULL, n_funds, normalized_label FROM dup)""",
    "reasons": """SELECT cik, CASE WHEN kind = 'stale_fund' THEN 2 WHEN kind = 'aum_jump' AND detail <> 'critical' THEN 1 ELSE 3 END AS rk,
   CASE WHEN kind = 'aum_jump' THEN 'current_aum_jump' ELSE kind END AS code FROM found WHERE temporal_scope = 'current_quarter'
  UNION ALL SELECT cik, 3, 'missing_latest_filing' FROM f_funds WHERE cik NOT IN (SELECT cik FROM fr)
  UNION ALL SELECT cik, 3, 'partial_amendment_latest' FROM fr JOIN latest USING (cik) WHERE report_date = q AND form LIKE '%/A' AND n_positions <= 3""",
    "gate": """SELECT f.cik, f.label, coalesce(r.rk, 0) AS rk, (['trusted', 'degraded', 'stale', 'quarantined'])[coalesce(r.rk, 0) + 1] AS status,
  coalesce(r.rk, 0) = 0 AS signal_eligible, coalesce(p.n, 0) AS series_points, coalesce(r.codes, 'passed_automated_quality_gate') AS reasons
 FROM f_funds f LEFT JOIN (SELECT cik, max(rk) AS rk, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM reasons GROUP BY cik) r USING (cik)
 LEFT JOIN (SELECT cik, count(*) AS n FROM fr GROUP BY cik) p USING (cik)""",
    "summary": """SELECT *, aum_jump_warnings + stale_funds + duplicate_labels + unit_scale_candidates AS review_items FROM (SELECT
  (SELECT count(*) FROM found WHERE kind = 'aum_jump') AS aum_jump_warnings,
  (SELECT count(*) FROM found WHERE kind = 'aum_jump' AND temporal_scope = 'current_quarter') AS current_aum_jump_warnings,
  (SELECT count(*) FROM found WHERE kind = 'aum_jump' AND temporal_scope = 'historical') AS historical_aum_jump_warnings,
  (SELECT count(*) FROM stale) AS stale_funds,
  (SELECT count(DISTINCT normalized_label) FROM dup) AS duplicate_labels,
  (SELECT count(*) FROM units) AS unit_scale_candidates,
  (SELECT count(*) FROM found WHERE kind = 'unit_scale_candidate' AND temporal_scope = 'current_quarter') AS current_unit_scale_candidates,
  (SELECT count(*) FROM found WHERE kind = 'unit_scale_candidate' AND temporal_scope = 'historical') AS historical_unit_scale_candidates,
  (SELECT count(DISTINCT cik) FROM fr) AS funds_scanned, (SELECT count(*) FROM fr) AS series_points, (SELECT q FROM sq) AS current_quarter)""",
}

SQL = {
    "w4_aum_jumps": "SELECT cik, prev_report_date, report_date, round(ratio, 6) AS ratio, direction, severity FROM jumps",
    "w4_aum_jumps_low_threshold": """SELECT cik, report_date, round(r, 6) AS ratio, CASE WHEN v > pv THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN r >= 1000 THEN 'critical' WHEN r >= 250 THEN 'high' ELSE 'review' END AS severity
 FROM (SELECT *, greatest(v / pv, pv / v) AS r FROM (SELECT cik, report_date, round(total_value, 2) AS v,
   lag(round(total_value, 2)) OVER (PARTITION BY cik ORDER BY report_date) AS pv FROM resolved)) WHERE r >= 3""",
    "w5_unit_candidates": "SELECT cik, report_date, next_report_date, round(neighbor_ratio, 6) AS neighbor_ratio, round(g, 8) AS ratio_to_neighbor_geomean, action FROM units",
    "w8_stale_funds": "SELECT * FROM stale",
    "w17_temporal_scope": "SELECT kind, temporal_scope, count(*) AS n FROM found GROUP BY ALL",
    "a9_signal_quarter": "SELECT q AS current_quarter FROM sq",
    "a10_duplicate_labels": "SELECT normalized_label, cik, label, n_funds FROM dup",
    "f20_severity_and_worst_status": """SELECT cik, CAST(rk AS BIGINT) AS status_rank, CASE WHEN max(ratio) >= 1000 THEN 'critical' WHEN max(ratio) >= 250 THEN 'high' ELSE 'review' END AS severity
 FROM gate JOIN jumps USING (cik) GROUP BY cik, rk""",
    "l5_findings_in_order": """SELECT cik, event_quarter, temporal_scope, round(size, 6) AS size FROM found WHERE kind = 'aum_jump'
 ORDER BY temporal_scope <> 'current_quarter', round(size, 6) DESC, cik, event_quarter""",
    "v2_quality_summary": """SELECT *, CASE WHEN review_items > 0 THEN 'review' ELSE 'ok' END AS status,
  CASE WHEN current_review_items > 0 THEN 'review' ELSE 'ok' END AS current_status,
  review_items - current_review_items - historical_review_items AS outside_current_quarter_review_items FROM (
 SELECT *, current_aum_jump_warnings + stale_funds + duplicate_labels + current_unit_scale_candidates AS current_review_items,
  historical_aum_jump_warnings + historical_unit_scale_candidates AS historical_review_items FROM summary)""",
    "v3_quality_gate": "SELECT cik, label, status, signal_eligible, series_points, reasons FROM gate",
    "v3_gate_summary": """SELECT count(*) AS active_funds, count(*) FILTER (status = 'trusted') AS trusted_funds, count(*) FILTER (status = 'degraded') AS degraded_funds,
  count(*) FILTER (status = 'stale') AS stale_funds, count(*) FILTER (status = 'quarantined') AS quarantined_funds,
  count(*) FILTER (signal_eligible) AS signal_eligible_funds, CASE WHEN bool_and(status = 'trusted') THEN 'ok' ELSE 'gated' END AS status FROM gate""",
    "p19_trusted_funds": """SELECT report_date, count(*) AS filings, round(sum(v), 2) AS total_value FROM fr WHERE cik IN (SELECT cik FROM gate WHERE signal_eligible) GROUP BY ALL""",
    "a28_content_check": """SELECT *, CASE WHEN funds > 0 AND filings > 0 AND latest_filings > 0 THEN 'pass' ELSE 'fail' END AS content,
  CASE WHEN current_unit_scale_candidates > 0 THEN 'fail' ELSE 'pass' END AS data_quality FROM (
 SELECT (SELECT count(*) FROM f_funds) AS funds, (SELECT count(*) FROM f_filings) AS filings, (SELECT count(*) FROM fr) AS latest_filings, current_unit_scale_candidates FROM summary)""",
}


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
