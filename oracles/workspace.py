"""SQL for the page, watchlist, audit and streaming queries."""

from oracles.base import NOW, sql
from oracles.quality import EXTRA as QUALITY

FLOWC = """ticker, holder_count, buyers_count, sellers_count, new_positions, exits, round(total_value_usd, 2) AS total_value_usd, score, action, triggers, codes"""
RANK = "CASE action WHEN 'alert' THEN 0 WHEN 'watch' THEN 1 WHEN 'monitor' THEN 2 ELSE 3 END"
T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SIZE = """CASE WHEN move IN ('NEW', 'EXIT', 'HOLD') THEN greatest(round(curr_value, 2), round(prev_value, 2)) ELSE abs(coalesce(round(share_change_pct, 9), 0)) END"""


def sat(n: str, half: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {n} / ({n} + {half}::DOUBLE) ELSE 0.0::DOUBLE END)"


EXTRA = {
    **QUALITY,
    "flow0": """SELECT report_date, ticker, count(*) FILTER (move <> 'EXIT') AS holder_count, count(*) FILTER (move IN ('NEW', 'ADD')) AS buyers_count, count(*) FILTER (move IN ('EXIT', 'TRIM')) AS sellers_count,
  count(*) FILTER (move = 'NEW') AS new_positions, count(*) FILTER (move = 'EXIT') AS exits, sum(curr_value) AS total_value_usd, avg(curr_weight) FILTER (move <> 'EXIT') AS aw, list(DISTINCT move) AS code_list,
  string_agg(DISTINCT move, ';' ORDER BY move) AS codes FROM (SELECT report_date, ticker, cik, move, sum(curr_value) AS curr_value, max(curr_weight) AS curr_weight
   FROM f_moves WHERE put_call = '' AND ticker IS NOT NULL AND cik IN (SELECT cik FROM gate WHERE signal_eligible) GROUP BY ALL) GROUP BY ALL""",
    "flow": f"""SELECT *, CASE WHEN score >= 50 OR (new_positions >= 1 AND score >= 30) THEN 'alert' WHEN score >= 30 THEN 'watch' ELSE 'monitor' END AS action,
  concat_ws(';', CASE WHEN buyers_count >= 2 THEN 'accumulation' END, CASE WHEN score >= 50 THEN 'high_score' END, CASE WHEN new_positions >= 1 THEN 'new_position' END) AS triggers
 FROM (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 30 * {sat('buyers_count', '2')} + 30 * {sat('new_positions', '1')} + 20 * least(1.0::DOUBLE, coalesce(aw, 0) / 0.05::DOUBLE)
  + 20 * {sat('greatest(buyers_count - sellers_count, 0)', '2')} - 20 * {sat('sellers_count', '2')})), 6) AS score FROM flow0)""",
    "nflow": "SELECT * EXCLUDE (report_date) FROM flow WHERE report_date = (SELECT max(report_date) FROM flow)",
    "wl": "SELECT *, unnest(tickers) AS ticker FROM watchlists",
    "wsig": """SELECT w.watchlist_id, w.key_id, f.ticker, f.action, f.score FROM wl w JOIN nflow f ON f.ticker = w.ticker
 WHERE (w.actions IS NULL OR list_contains(w.actions, f.action)) AND (w.moves IS NULL OR list_has_any(w.moves, f.code_list)) AND (w.min_score IS NULL OR f.score >= w.min_score)
  AND (w.min_holders IS NULL OR f.holder_count >= w.min_holders) AND (w.min_buyers IS NULL OR f.buyers_count >= w.min_buyers) AND (w.max_13f_value_usd IS NULL OR f.total_value_usd <= w.max_13f_value_usd)""",
    "newest": "SELECT cik, accession FROM filings QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) = 1",
    "subs": """SELECT 'u' || c_custkey AS subscription_id, c_name AS user_id, lpad(CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 10, '0') AS cik, c_custkey % 4 <> 1 AS active, c_custkey FROM customer""",
    "sched": f"""SELECT w.*, k.label AS key_label, s.latest AS latest_snapshot_at, enabled AND frequency IN ('daily', 'weekly') AS valid,
  enabled AND frequency IN ('daily', 'weekly') AND (s.latest IS NULL OR s.latest <= {NOW} - to_days(CASE WHEN frequency = 'weekly' THEN 7 ELSE 1 END)) AS due
 FROM watchlists w JOIN api_keys k ON k.key_id = w.key_id LEFT JOIN (SELECT key_id, watchlist_id, max(created_at) AS latest FROM wsnaps GROUP BY ALL) s ON s.key_id = w.key_id AND s.watchlist_id = w.watchlist_id
 WHERE k.revoked_at IS NULL AND (k.expires_at IS NULL OR k.expires_at > {NOW})""",
    "life": f"""SELECT *, r AS revoked, e AS expired, NOT r AND NOT e AS active, NOT r AND NOT e AND coalesce(rotation_due_at <= {NOW}, false) AS rotation_due,
  NOT r AND NOT e AND coalesce(rotation_due_at > {NOW} AND rotation_due_at <= {NOW} + to_days(14), false) AS rotation_due_soon
 FROM (SELECT *, revoked_at IS NOT NULL AS r, revoked_at IS NULL AND coalesce(expires_at <= {NOW}, false) AS e FROM api_keys)""",
    "usage": f"""SELECT k.*, coalesce(m, 0) AS minute_used, coalesce(d, 0) AS day_used, coalesce(mo, 0) AS month_used FROM api_keys k LEFT JOIN (
  SELECT key_id, count(*) FILTER (tm >= date_trunc('minute', {NOW})) AS m, count(*) FILTER (tm >= date_trunc('day', {NOW})) AS d, count(*) AS mo FROM ev WHERE tm <= {NOW} AND tm >= date_trunc('month', {NOW}) GROUP BY 1) u USING (key_id)""",
    "rank2": "SELECT *, row_number() OVER (PARTITION BY key_id, watchlist_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM wsnaps",
    "pair": "SELECT watchlist_id, max(snapshot_id) FILTER (rn = 1) AS snapshot_id, max(snapshot_id) FILTER (rn = 2) AS baseline_snapshot_id FROM rank2 GROUP BY key_id, watchlist_id",
    "close": f"""SELECT l.*, coalesce(a.n, 0) AS requests, coalesce(a.ok, 0) AS okc, coalesce(a.er, 0) AS errors, coalesce(a.se, 0) AS server_errors, coalesce(a.rl, 0) AS rate_limited,
  coalesce(w.n, 0) AS watchlists, coalesce(w.c, 0) AS watchlists_created, coalesce(s.n, 0) AS snapshots, coalesce(x.n, 0) AS alerts, coalesce(x.o, 0) AS open_alerts, coalesce(x.f, 0) AS new_alerts
 FROM life l LEFT JOIN (SELECT key_id, count(*) AS n, count(*) FILTER (status BETWEEN 200 AND 399) AS ok, count(*) FILTER (status >= 400) AS er, count(*) FILTER (status >= 500) AS se, count(*) FILTER (status = 429) AS rl FROM ev WHERE tm >= {NOW} - to_days(7) GROUP BY 1) a USING (key_id)
 LEFT JOIN (SELECT key_id, count(*) AS n, count(*) FILTER (created_at >= {NOW} - to_days(7)) AS c FROM watchlists GROUP BY 1) w USING (key_id)
 LEFT JOIN (SELECT key_id, count(*) FILTER (created_at >= {NOW} - to_days(7)) AS n FROM wsnaps GROUP BY 1) s USING (key_id)
 LEFT JOIN (SELECT key_id, count(*) AS n, count(*) FILTER (status = 'open') AS o, count(*) FILTER (first_seen_at >= {NOW} - to_days(7)) AS f FROM walerts GROUP BY 1) x USING (key_id)
 WHERE NOT contains(scopes, 'admin:read') AND (created_at >= {NOW} - to_days(7) OR last_used_at >= {NOW} - to_days(7))""",
    "tele": """SELECT *, CAST(ts AS DATE) AS day, CAST(CASE WHEN duration_ms < 0 THEN 0 ELSE least(round(duration_ms), 60000) END AS BIGINT) AS ms,
  CASE client WHEN 'codex-cli' THEN 'Codex' WHEN 'ChatGPT' THEN 'ChatGPT' WHEN 'cursor 1.2' THEN 'Cursor' WHEN 'VS Code; vscode' THEN 'VS Code' WHEN 'my cline bot' THEN 'Cline' WHEN 'mcp-inspector' THEN 'MCP Inspector' ELSE 'Other MCP clients' END AS family FROM telemetry""",
    "fold": """SELECT key_id AS alert_id, tm, CASE WHEN k < 10 THEN 'open' WHEN k % 2 = 0 THEN 'acknowledged' ELSE 'dismissed' END AS status FROM ev""",
    "dlog": "SELECT key_id, tool, tm, CASE WHEN k > 97 THEN 'sent' WHEN k > 95 THEN 'primed' ELSE 'failed' END AS status FROM ev",
}
TELE = """CAST(count(*) FILTER (kind = 'http') AS BIGINT) AS http_requests, count(*) FILTER (kind = 'http' AND status BETWEEN 200 AND 299) AS http_2xx, count(*) FILTER (kind = 'http' AND status BETWEEN 400 AND 499) AS http_4xx,
  count(*) FILTER (kind = 'http' AND status >= 500) AS http_5xx, count(*) FILTER (kind = 'initialize') AS initializations, count(*) FILTER (kind = 'tool') AS tool_calls, count(*) FILTER (kind = 'tool' AND success) AS tool_successes,
  CAST(coalesce(sum(ms) FILTER (kind = 'tool'), 0) AS BIGINT) AS tool_duration_ms, coalesce(max(ms) FILTER (kind = 'tool'), 0) AS max_tool_latency_ms, count(*) FILTER (kind = 'tool' AND NOT success) AS tool_errors,
  round(count(*) FILTER (kind = 'tool' AND success) / nullif(count(*) FILTER (kind = 'tool'), 0), 4) AS tool_success_rate, CAST(round(sum(ms) FILTER (kind = 'tool') / nullif(count(*) FILTER (kind = 'tool'), 0)) AS BIGINT) AS average_tool_latency_ms"""
QUOTA = """CASE WHEN rate_per_{u} > 0 THEN greatest(rate_per_{u} - {x}, 0) ELSE 0 END"""

SQL = {
    "v5_fund_list": """SELECT f.cik, f.label, r.report_date AS latest_quarter, round(r.total_value, 2) AS aum, r.n_positions, n.c AS n_quarters FROM funds f
 LEFT JOIN (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY cik ORDER BY report_date DESC) = 1) r ON r.cik = f.cik LEFT JOIN (SELECT cik, count(*) AS c FROM resolved GROUP BY 1) n ON n.cik = f.cik""",
    "v6_fund_detail": """SELECT r.cik, r.report_date, r.accession, r.form, q.prev_report_date, r.n_positions, g.status, m.* EXCLUDE (cik, report_date) FROM f_resolved r JOIN latest l ON l.cik = r.cik AND l.q = r.report_date
 JOIN f_prevq q ON q.accession = r.accession JOIN gate g ON g.cik = r.cik JOIN (SELECT cik, report_date, count(*) FILTER (move = 'NEW') AS n_new, count(*) FILTER (move = 'ADD') AS n_add, count(*) FILTER (move = 'TRIM') AS n_trim,
  count(*) FILTER (move = 'EXIT') AS n_exit, count(*) FILTER (move = 'HOLD') AS n_hold FROM f_moves GROUP BY ALL) m ON m.cik = r.cik AND m.report_date = r.report_date""",
    "v7_ticker_flow": f"SELECT report_date, {FLOWC} FROM flow",
    "v8_watchlist_preview": f"""SELECT w.ticker, coalesce(holder_count, 0) AS holder_count, coalesce(buyers_count, 0) AS buyers_count, coalesce(sellers_count, 0) AS sellers_count, coalesce(new_positions, 0) AS new_positions, coalesce(exits, 0) AS exits,
  round(coalesce(total_value_usd, 0), 2) AS total_value_usd, coalesce(score, 0) AS score, coalesce(action, 'blocked') AS action, coalesce(triggers, '') AS triggers, coalesce(codes, '') AS codes
 FROM (SELECT DISTINCT ticker FROM wl UNION ALL SELECT 'NONE') w LEFT JOIN nflow f ON f.ticker = w.ticker""",
    "v9_discover": f"SELECT ticker, action, score, buyers_count, new_positions FROM nflow ORDER BY {RANK}, score DESC, buyers_count DESC, new_positions DESC, ticker LIMIT 10",
    "p16_discover_filters": f"""SELECT ticker, action, score, buyers_count, new_positions FROM nflow WHERE action IN ('alert', 'watch') AND list_contains(code_list, 'NEW') AND score >= 20 AND holder_count >= 1 AND buyers_count >= 1 AND total_value_usd < 1e8
 ORDER BY {RANK}, score DESC, buyers_count DESC, new_positions DESC, ticker LIMIT 50""",
    "p15_watchlist_filters": "SELECT watchlist_id, ticker, action, score FROM wsig",
    "v10_watchlist_signals": "SELECT w.watchlist_id, w.name, 3::BIGINT AS input_count, coalesce(n, 0) AS returned_count FROM watchlists w LEFT JOIN (SELECT watchlist_id, count(*) AS n FROM wsig GROUP BY 1) s USING (watchlist_id)",
    "a29_action_summary": "SELECT watchlist_id, count(*) FILTER (action = 'alert') AS alerts, count(*) FILTER (action = 'watch') AS watch, count(*) FILTER (action = 'monitor') AS monitor, count(*) FILTER (action = 'blocked') AS blocked FROM wsig GROUP BY 1",
    "j15_snapshot_delta": """SELECT coalesce(c.report_date, p.d) AS report_date, coalesce(c.ticker, p.ticker) AS ticker, CASE WHEN p.ticker IS NULL THEN 'added' WHEN c.ticker IS NULL THEN 'removed' ELSE 'kept' END AS change,
  coalesce(c.action <> p.action, false) AS action_changed, coalesce(abs(c.score - p.score) >= 0.1, false) AS score_changed FROM flow c
 FULL OUTER JOIN (SELECT *, CAST(last_day(CAST(report_date + INTERVAL 3 MONTH AS DATE)) AS DATE) AS d FROM flow) p ON p.d = c.report_date AND p.ticker = c.ticker""",
    "o4_shared_tickers": "SELECT ticker FROM flow WHERE report_date = (SELECT min(report_date) FROM flow) INTERSECT SELECT ticker FROM flow WHERE report_date = (SELECT max(report_date) FROM flow)",
    "p17_fund_search": "SELECT cik, label, count(*) OVER () AS total FROM funds WHERE cik LIKE '%1%' OR label LIKE '%1%' ORDER BY label, cik LIMIT 10 OFFSET 10",
    "p18_bounded_lists": """SELECT report_date, cusip, cik, row_number() OVER w AS place, count(*) OVER (PARTITION BY report_date, cusip) AS available FROM snap WHERE put_call = ''
 WINDOW w AS (PARTITION BY report_date, cusip ORDER BY round(value_usd, 2) DESC, cik) QUALIFY row_number() OVER w <= 5""",
    "p20_moves_without_hold": """SELECT cik, report_date, row_number() OVER w AS place, cusip, put_call, move FROM moves WHERE move <> 'HOLD'
 WINDOW w AS (PARTITION BY cik, report_date ORDER BY greatest(round(curr_value, 2), round(prev_value, 2)) DESC, cusip, put_call) QUALIFY row_number() OVER w <= 10""",
    "v13_fund_print": f"""SELECT s.cik, 'HOLDING' AS part, row_number() OVER (PARTITION BY s.cik ORDER BY round(value_usd, 2) DESC, cusip, put_call) AS place, cusip, put_call FROM snap s JOIN (SELECT cik, max(report_date) AS q FROM resolved GROUP BY 1) l ON l.cik = s.cik AND l.q = s.report_date
 QUALIFY row_number() OVER (PARTITION BY s.cik ORDER BY round(value_usd, 2) DESC, cusip, put_call) <= 3
 UNION ALL (SELECT m.cik, move, row_number() OVER (PARTITION BY m.cik, move ORDER BY {SIZE} DESC, cusip, put_call) AS place, cusip, put_call FROM moves m JOIN (SELECT cik, max(report_date) AS q FROM resolved GROUP BY 1) l ON l.cik = m.cik AND l.q = m.report_date
  WHERE move <> 'HOLD' QUALIFY row_number() OVER (PARTITION BY m.cik, move ORDER BY {SIZE} DESC, cusip, put_call) <= 2)""",
    "v12_filing_alerts": """SELECT r.cik, f.label || ' 13F' || CASE WHEN form LIKE '%/A' THEN ' (amendment)' ELSE '' END || ' (' || r.report_date || '): ' || CASE WHEN n_new + n_exit = 0 THEN 'filing update' ELSE concat_ws(', ', CASE WHEN n_new > 0 THEN n_new || ' new' END, CASE WHEN n_exit > 0 THEN n_exit || ' exits' END) END AS subject,
  'Quarter ' || r.report_date || coalesce(' vs ' || q.prev_report_date, ' (first filing on record)') || ' | filed ' || r.filing_date || ' | ' || form AS line, n_new, n_exit, n_add, n_trim
 FROM resolved r JOIN prevq q ON q.accession = r.accession JOIN funds f ON f.cik = r.cik JOIN (SELECT cik, report_date, count(*) FILTER (move = 'NEW') AS n_new, count(*) FILTER (move = 'EXIT') AS n_exit, count(*) FILTER (move = 'ADD') AS n_add, count(*) FILTER (move = 'TRIM') AS n_trim FROM moves GROUP BY ALL) m
  ON m.cik = r.cik AND m.report_date = r.report_date QUALIFY row_number() OVER (PARTITION BY r.cik ORDER BY r.report_date DESC) = 1""",
    "a27_live_status": """SELECT (SELECT count(*) FROM funds) AS funds, (SELECT count(*) FROM filings) AS filings, (SELECT max(filing_date) FROM filings) AS data_as_of, (SELECT min(report_date) FROM resolved) AS first_quarter, (SELECT max(report_date) FROM resolved) AS last_quarter,
  (SELECT CAST(sum(n_positions) AS BIGINT) FROM resolved) AS positions, (SELECT round(sum(value_usd) FILTER (ticker IS NOT NULL) / sum(value_usd), 6) FROM snap WHERE put_call = '') AS value_share""",
    "j12_pending_deliveries": "SELECT subscription_id, s.cik, accession FROM subs s JOIN newest n ON n.cik = s.cik WHERE active AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0",
    "p21_active_subscriptions": "SELECT cik, count(*) AS subscribers FROM subs WHERE active GROUP BY 1",
    "st2_primed_deliveries": "SELECT subscription_id, accession, 'primed' AS status FROM subs s JOIN newest n ON n.cik = s.cik WHERE active",
    "st3_delivery_outcomes": f"SELECT key_id AS subscription_id, tool AS accession, arg_max(status, (status IN ('sent', 'primed'), tm, status)) AS status, {T.format('max(tm)')} AS delivered_at FROM dlog GROUP BY ALL",
    "st3_reactivation": "SELECT subscription_id, user_id, active OR c_custkey % 2 = 0 AS active FROM subs",
    "a18_status_rollup": f"""SELECT key_id, count(*) AS total, {T.format('max(tm)')} AS latest_at, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 401) AS unauthorized, count(*) FILTER (status = 403) AS forbidden,
  count(*) FILTER (status = 429) AS rate_limited, count(*) FILTER (status >= 500) AS server_errors FROM ev GROUP BY ALL""",
    "a19_route_rollup": """SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY count DESC, m DESC, route, method) AS route_rank FROM (SELECT key_id, route, method, count(*) AS count, max(tm) AS m, count(*) FILTER (status >= 400) AS errors FROM ev GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY count DESC, m DESC, route, method) <= 3""",
    "a20_usage_report": f"""SELECT key_id, minute_used, day_used, month_used, {QUOTA.format(u='min', x='minute_used')} AS minute_remaining, round(minute_used / nullif(rate_per_min, 0) * 100, 2) AS minute_used_pct,
  {QUOTA.format(u='day', x='day_used')} AS day_remaining, round(day_used / nullif(rate_per_day, 0) * 100, 2) AS day_used_pct FROM usage""",
    "j14_keys_and_usage": "SELECT key_id, label, tier, minute_used, day_used FROM usage ORDER BY day_used DESC, minute_used DESC, created_at DESC LIMIT 25",
    "f17_quota": f"SELECT key_id, day, used, {QUOTA.format(u='day', x='used')} AS remaining, round(used / nullif(rate_per_day, 0) * 100, 2) AS used_pct FROM (SELECT key_id, CAST(tm AS DATE) AS day, count(*) AS used FROM ev GROUP BY ALL) JOIN api_keys USING (key_id)",
    "a21_key_lifecycle": "SELECT key_id, active, revoked, expired, rotation_due, rotation_due_soon FROM life",
    "a22_health_report": f"""SELECT *, concat_ws('; ', CASE WHEN active = 0 THEN 'no active key' END, CASE WHEN server_errors > 0 THEN 'audit contains server errors' END, CASE WHEN rate_limited > 0 THEN 'audit contains rate-limited requests' END,
  CASE WHEN rotation_due > 0 THEN 'active keys are due for rotation' END, CASE WHEN rotation_due_soon > 0 THEN 'active keys rotate within 14 days' END) AS warnings, CASE WHEN active = 0 OR server_errors > 0 OR rotation_due > 0 THEN 'warn' ELSE 'ok' END AS status FROM (
 SELECT a.*, l.* FROM (SELECT count(*) AS total, {T.format('max(tm)')} AS latest_at, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 429) AS rate_limited, count(*) FILTER (status >= 500) AS server_errors FROM ev) a,
 (SELECT count(*) AS keys, count(*) FILTER (active) AS active, count(*) FILTER (revoked) AS revoked, count(*) FILTER (expired) AS expired, count(*) FILTER (rotation_due) AS rotation_due, count(*) FILTER (rotation_due_soon) AS rotation_due_soon FROM life) l)""",
    "a24_closeout_keys": "SELECT key_id, requests, okc AS ok, errors, server_errors, watchlists, watchlists_created, snapshots, alerts, open_alerts, new_alerts, revoked, expired, rotation_due FROM close",
    "a24_closeout_verdict": """SELECT *, CASE WHEN keys = 0 OR server_errors > 0 OR ok = 0 THEN 'hold' WHEN lifecycle_actions > 0 THEN 'continue' WHEN requests >= 10 AND (watchlists > 0 OR snapshots > 0) THEN 'expand_candidate' ELSE 'continue' END AS verdict FROM (
 SELECT count(*) AS keys, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(okc) AS BIGINT) AS ok, CAST(sum(server_errors) AS BIGINT) AS server_errors, CAST(sum(rate_limited) AS BIGINT) AS rate_limited, CAST(sum(watchlists) AS BIGINT) AS watchlists,
  CAST(sum(snapshots) AS BIGINT) AS snapshots, CAST(sum(alerts) AS BIGINT) AS alerts, CAST(sum(open_alerts) AS BIGINT) AS open_alerts, count(*) FILTER (revoked OR expired OR rotation_due) AS lifecycle_actions
 FROM close)""",
    "a33_audit_freshness": f"SELECT count(*) AS rows, {T.format('max(tm)')} AS last_at, CASE WHEN max(tm) < TIMESTAMP '2024-02-01 00:00:00' THEN 'warn' ELSE 'pass' END AS status FROM ev",
    "st6_audit_retention": f"SELECT count(*) AS before, count(*) FILTER (tm >= {NOW} - to_days(10)) AS after, count(*) FILTER (tm < {NOW} - to_days(10)) AS deleted FROM ev",
    "a34_watchlists_per_key": "SELECT key_id, count(*) AS watchlists, count(*) >= 10 AS at_limit FROM watchlists GROUP BY 1",
    "l8_recent_errors": "SELECT id, key_id, method, route, status FROM ev WHERE status >= 400 ORDER BY tm DESC, id DESC LIMIT 50",
    "l11_keys_newest_first": """SELECT k.key_id, k.label, w.name AS last_watchlist FROM api_keys k LEFT JOIN (SELECT * FROM watchlists QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY updated_at DESC, name) = 1) w USING (key_id) ORDER BY k.created_at DESC, k.key_id""",
    "a23_workspace_totals": f"""SELECT w.key_id, w.n AS watchlists, s.n AS signal_snapshots, {T.format('s.m')} AS latest_snapshot_at, a.n AS alerts, a.o AS open, a.k AS acknowledged, a.d AS dismissed FROM (SELECT key_id, count(*) AS n FROM watchlists GROUP BY 1) w
 LEFT JOIN (SELECT key_id, count(*) AS n, max(created_at) AS m FROM wsnaps GROUP BY 1) s USING (key_id)
 LEFT JOIN (SELECT key_id, count(*) AS n, count(*) FILTER (status = 'open') AS o, count(*) FILTER (status = 'acknowledged') AS k, count(*) FILTER (status = 'dismissed') AS d FROM walerts GROUP BY 1) a USING (key_id)""",
    "j13_watchlist_schedule": f"SELECT watchlist_id, key_label, {T.format('latest_snapshot_at')} AS latest_snapshot_at, due FROM sched",
    "st10_due_watchlists": "SELECT watchlist_id, frequency FROM sched WHERE due ORDER BY latest_snapshot_at NULLS FIRST, updated_at DESC, watchlist_id",
    "a25_automation_demand": f"""SELECT count(*) FILTER (enabled) AS scheduled_watchlists, count(*) FILTER (enabled AND frequency = 'daily') AS daily, count(*) FILTER (enabled AND frequency = 'weekly') AS weekly,
  count(*) FILTER (enabled AND frequency = 'manual') AS invalid_policy, count(*) FILTER (due) AS due_count, {T.format('max(latest_snapshot_at) FILTER (valid)')} AS latest_snapshot_at FROM sched""",
    "l7_alerts_by_severity": """SELECT key_id, alert_id, ticker, severity, row_number() OVER w AS alert_rank FROM walerts WHERE status = 'open' WINDOW w AS (PARTITION BY key_id ORDER BY severity DESC, last_seen_at DESC, ticker, alert_id) QUALIFY row_number() OVER w <= 3""",
    "w14_keep_newest": "SELECT watchlist_id, snapshot_id FROM rank2 WHERE rn <= 2",
    "w18_newest_snapshot": "SELECT * FROM pair",
    "v11_workspace_report": """SELECT w.watchlist_id, w.name, p.snapshot_id, p.baseline_snapshot_id, a.t AS top_alerts FROM watchlists w LEFT JOIN pair p USING (watchlist_id) LEFT JOIN (
  SELECT watchlist_id, string_agg(ticker, ';' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY watchlist_id ORDER BY severity DESC, last_seen_at DESC, ticker, alert_id) AS rn FROM walerts) WHERE rn <= 3 GROUP BY 1) a USING (watchlist_id)""",
    "k12_workspace_export": """SELECT w.watchlist_id, w.key_id, w.name, array_to_string(w.tickers, ';') AS tickers, p.snapshot_id AS latest_snapshot_id, a.ticker AS alert_ticker, a.action AS alert_action, a.severity AS alert_severity, a.status AS alert_status
 FROM watchlists w LEFT JOIN pair p ON p.watchlist_id = w.watchlist_id LEFT JOIN walerts a ON a.watchlist_id = w.watchlist_id""",
    "f26_alert_severity": "SELECT action, CAST(CASE action WHEN 'alert' THEN 3 WHEN 'watch' THEN 2 END AS BIGINT) AS severity, count(*) AS n FROM wsig GROUP BY ALL",
    "st9_alert_status_fold": f"""SELECT f.alert_id, arg_max(status, (tm, status)) AS status, {T.format("max(tm) FILTER (status = 'acknowledged' AND tm >= coalesce(o, tm))")} AS acknowledged_at, {T.format("max(tm) FILTER (status = 'dismissed' AND tm >= coalesce(o, tm))")} AS dismissed_at
 FROM fold f JOIN (SELECT alert_id, max(tm) FILTER (status = 'open') AS o FROM fold GROUP BY 1) x ON x.alert_id = f.alert_id GROUP BY f.alert_id""",
    "a26_telemetry_windows": f"""SELECT '7d' AS span, {TELE} FROM tele WHERE DATE '2024-01-31' - day < 7 UNION ALL SELECT '30d', {TELE} FROM tele WHERE DATE '2024-01-31' - day < 30 UNION ALL SELECT 'lifetime', {TELE} FROM tele""",
    "a26_telemetry_by_tool": f"SELECT tool, tool_calls, tool_successes, tool_errors, tool_success_rate, average_tool_latency_ms, max_tool_latency_ms FROM (SELECT tool, {TELE} FROM tele WHERE kind = 'tool' GROUP BY tool)",
    "l9_clients_by_use": "SELECT family AS client, count(*) AS initializations FROM tele WHERE kind = 'initialize' GROUP BY 1 ORDER BY 2 DESC, 1",
    "st4_rate_counts": "SELECT key_id, CAST(tm AS DATE) AS day, count(*) AS count, count(*) > any_value(rate_per_day) AS over_limit FROM ev JOIN api_keys USING (key_id) GROUP BY ALL",
    "st4_minute_counts": "SELECT count, count(*) AS windows FROM (SELECT key_id, date_trunc('minute', tm) AS m, count(*) AS count FROM ev GROUP BY ALL) GROUP BY 1",
    "st7_daily_counters": """SELECT day, tool, count(*) AS tool_calls, count(*) FILTER (success) AS tool_successes, round(max(duration_ms), 6) AS tool_max_ms FROM tele WHERE kind = 'tool' AND day BETWEEN DATE '2024-01-17' AND DATE '2024-01-30' GROUP BY ALL""",
    "st13_audit_appends": "SELECT key_id, status, count(*) AS n FROM ev GROUP BY ALL",
    "st14_sliding_windows": """SELECT ticker, transaction_date + CAST(i AS INTEGER) AS window_end, count(*) AS buys, round(sum(shares * price_per_share), 2) AS buy_usd FROM trades, range(1, 15) r(i) WHERE transaction_code = 'P' AND acquired_disposed = 'A' GROUP BY ALL""",
    "st1_filing_alert_stream": "SELECT subscription_id, accession, 'sent' AS status FROM subs s JOIN newest n ON n.cik = s.cik WHERE active",
    "st12_late_amendments": "SELECT cik, report_date, accession FROM resolved",
    "st8_alert_upserts": """SELECT ticker, action, 'open' AS status, CAST(max(report_date) AS VARCHAR) AS snapshot_id, min(report_date) AS first_seen, max(report_date) AS last_seen, CAST(CASE action WHEN 'alert' THEN 3 ELSE 2 END AS BIGINT) AS severity
 FROM flow WHERE action IN ('alert', 'watch') GROUP BY ALL""",
    "st5_client_windows": """SELECT key_id, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS refused FROM (
 WITH RECURSIVE e AS (SELECT key_id, epoch_ms(tm) AS ms FROM ev),
 w AS (SELECT key_id, min(ms) AS s FROM e GROUP BY 1 UNION ALL SELECT w.key_id, min(e.ms) FROM w JOIN e ON e.key_id = w.key_id AND e.ms >= w.s + 21600000 GROUP BY w.key_id, w.s)
 SELECT w.key_id, w.s, count(*) AS n FROM w JOIN e ON e.key_id = w.key_id AND e.ms >= w.s AND e.ms < w.s + 21600000 GROUP BY 1, 2) GROUP BY key_id""",
    "st11_snapshot_run": """SELECT d.watchlist_id, d.key_id, count(*) FILTER (action = 'alert') AS alerts, count(*) FILTER (action = 'watch') AS watch, count(*) FILTER (action = 'monitor') AS monitor, count(*) FILTER (action = 'blocked') AS blocked
 FROM (SELECT * FROM sched WHERE due ORDER BY latest_snapshot_at NULLS FIRST, updated_at DESC, watchlist_id) d LEFT JOIN wsig s ON s.watchlist_id = d.watchlist_id GROUP BY ALL""",
}
SQL["a19_route_rollup"] = f"SELECT * EXCLUDE (m) FROM ({SQL['a19_route_rollup']})"


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
