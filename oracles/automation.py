"""SQL for the automated snapshot runs."""

from oracles.base import sql
from oracles.workspace import EXTRA as WORKSPACE, T

EXTRA = {
    **WORKSPACE,
    "ends": "SELECT max(report_date) AS b, (SELECT max(report_date) FROM flow WHERE report_date < (SELECT max(report_date) FROM flow)) AS a FROM flow",
    "ticks": """SELECT 0 AS run, a AS q, a + INTERVAL 12 HOUR AS run_at FROM ends UNION ALL SELECT 1, b, b + INTERVAL 12 HOUR FROM ends
 UNION ALL SELECT 2, b, b + INTERVAL 60 HOUR FROM ends""",
    "saved": """SELECT *, CASE CAST(substr(watchlist_id, 2) AS BIGINT) % 17 WHEN 3 THEN 'filters are not JSON' WHEN 5 THEN 'min_score is not double' END AS error FROM watchlists""",
    "duelist": """SELECT t.*, s.*, substr(sha256(s.watchlist_id || '|' || strftime(run_at, '%Y-%m-%d %H:%M:%S')), 1, 16) AS snapshot_id
 FROM ticks t, saved s JOIN api_keys k ON k.key_id = s.key_id
 WHERE k.revoked_at IS NULL AND (k.expires_at IS NULL OR k.expires_at > run_at) AND enabled AND frequency IN ('daily', 'weekly')
  AND (run < 2 OR frequency = 'daily' OR error IS NOT NULL)""",
    "asked": "SELECT *, unnest(tickers) AS ticker FROM duelist WHERE error IS NULL",
    "runsig": """SELECT d.run, d.run_at, d.key_id, d.watchlist_id, d.ticker, coalesce(f.action, 'blocked') AS action, coalesce(f.score, 0) AS score
 FROM asked d LEFT JOIN flow f ON f.report_date = d.q AND f.ticker = d.ticker
 WHERE (d.actions IS NULL OR list_contains(d.actions, coalesce(f.action, 'blocked'))) AND (d.moves IS NULL OR coalesce(list_has_any(d.moves, f.code_list), false))
  AND (d.min_score IS NULL OR coalesce(f.score, 0) >= d.min_score) AND (d.min_holders IS NULL OR coalesce(f.holder_count, 0) >= d.min_holders)
  AND (d.min_buyers IS NULL OR coalesce(f.buyers_count, 0) >= d.min_buyers) AND (d.max_13f_value_usd IS NULL OR coalesce(f.total_value_usd, 0) <= d.max_13f_value_usd)""",
    "raised": "SELECT * FROM runsig WHERE action IN ('alert', 'watch')",
    "before": "SELECT d.run, d.watchlist_id, max(e.run) AS earlier FROM duelist d JOIN duelist e ON e.watchlist_id = d.watchlist_id AND e.run < d.run WHERE d.error IS NULL GROUP BY ALL",
    "changes": """SELECT *, coalesce(from_action <> to_action, false) AS action_changed, coalesce(abs(to_score - from_score) >= 0.1, false) AS score_changed,
  CASE WHEN from_action IS NULL THEN 'added' WHEN to_action IS NULL THEN 'removed' ELSE 'kept' END AS change
 FROM (SELECT coalesce(n.run, o.run) AS run, coalesce(n.watchlist_id, o.watchlist_id) AS watchlist_id, coalesce(n.ticker, o.ticker) AS ticker,
   o.action AS from_action, n.action AS to_action, o.score AS from_score, n.score AS to_score
  FROM runsig n FULL OUTER JOIN (SELECT b.run, s.watchlist_id, s.ticker, s.action, s.score FROM before b JOIN runsig s ON s.watchlist_id = b.watchlist_id AND s.run = b.earlier) o
   ON o.run = n.run AND o.watchlist_id = n.watchlist_id AND o.ticker = n.ticker)""",
    "changed": "SELECT * FROM changes WHERE change <> 'kept' OR action_changed OR score_changed",
    "perlist": "SELECT run, watchlist_id, count(*) AS n, count(*) FILTER (action IN ('alert', 'watch')) AS candidates FROM runsig GROUP BY ALL",
    "alertsnow": """SELECT t.run, s.key_id, count(DISTINCT (s.watchlist_id, s.ticker, s.action)) AS open FROM ticks t JOIN raised s ON s.run <= t.run GROUP BY ALL""",
    "moved": """SELECT run, watchlist_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (action_changed) AS acted, count(*) FILTER (score_changed) AS rescored FROM changed GROUP BY ALL""",
}

SQL = {
    "st11_run_outcomes": f"""SELECT {T.format('run_at')} AS run_at, watchlist_id, frequency, CASE WHEN error IS NULL THEN coalesce(n, 0) END AS signals, error,
  NOT bool_or(error IS NOT NULL) OVER (PARTITION BY run) AS ok FROM duelist LEFT JOIN perlist USING (run, watchlist_id)""",
    "st11_run_alerts": f"""SELECT key_id, watchlist_id, ticker, action, CAST(CASE action WHEN 'alert' THEN 3 ELSE 2 END AS BIGINT) AS severity, 'open' AS status,
  arg_max(score, run) AS reason_score, {T.format('min(run_at)')} AS first_seen_at, {T.format('max(run_at)')} AS last_seen_at FROM raised GROUP BY ALL""",
    "st11_run_deltas": f"""SELECT {T.format('run_at')} AS created_at, watchlist_id, ticker, change, from_action, to_action, from_score, to_score, action_changed, score_changed,
  run > 0 AS has_baseline FROM changed JOIN ticks USING (run)""",
    "st13_activity": f"""SELECT key_id, 'signals.snapshot.automat' || CASE WHEN error IS NULL THEN 'ed' ELSE 'ion_failed' END AS event_type, watchlist_id AS entity_id,
  CASE WHEN error IS NULL THEN 'Automated signal snapshot: ' ELSE 'Automated snapshot failed: ' END || name AS title, {T.format('run_at')} AS created_at,
  CASE WHEN error IS NOT NULL THEN '{{"error":"' || error || '"}}' ELSE '{{"snapshot_id":"' || snapshot_id || '","signal_count":' || coalesce(n, 0) || ',"frequency":"' || frequency
   || '","alerts":{{"candidates":' || coalesce(candidates, 0) || ',"open":' || coalesce(open, 0) || ',"acknowledged":0,"dismissed":0}},"delta":{{"added":' || coalesce(added, 0)
   || ',"removed":' || coalesce(removed, 0) || ',"changed_actions":' || coalesce(acted, 0) || ',"changed_scores":' || coalesce(rescored, 0) || '}}}}' END AS detail
 FROM duelist LEFT JOIN perlist USING (run, watchlist_id) LEFT JOIN moved USING (run, watchlist_id) LEFT JOIN alertsnow USING (run, key_id)""",
}
SQL["st13_operator_events"] = f"""SELECT key_id || '|' || event_type AS id, key_id, event_type, md5(substr(repeat(label || ' ', 40), 1, 240)) AS title_md5,
  CAST(length(substr(repeat(label || ' ', 40), 1, 240)) AS BIGINT) AS title_length, {T.format('moment')} AS created_at
 FROM (SELECT key_id, label, 'api_key.created' AS event_type, created_at AS moment FROM api_keys UNION ALL SELECT key_id, label, 'api_key.revoked', revoked_at FROM api_keys WHERE revoked_at IS NOT NULL)"""


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
