"""SQL for the pages and reports that are long tables of sections."""

from oracles.automation import EXTRA as AUTOMATION
from oracles.base import NOW, sql
from oracles.filings import usd
from oracles.workspace import SQL as WORKSPACE_SQL, T

KINDS = {"name": "VARCHAR", "code": "VARCHAR", "day": "DATE", "at": "VARCHAR", "amount": "DOUBLE", "ratio": "DOUBLE", "n": "BIGINT", "detail": "VARCHAR"}
DETAIL = f"""CASE move WHEN 'NEW' THEN 'NEW ' || {usd('round(curr_value, 2)')} WHEN 'EXIT' THEN 'EXIT ' || {usd('round(prev_value, 2)')}
 ELSE coalesce(CASE WHEN share_change_pct < 0 THEN '-' ELSE '+' END || CAST(abs(round(round(share_change_pct, 9) * 100)) AS BIGINT) || '% shares', move) END
 || CASE WHEN put_call <> '' THEN ' [' || put_call || ']' ELSE '' END"""
BIG = "round(greatest(round(curr_value, 2), round(prev_value, 2)), 2)"


def part(keys: str, title: str, source: str, order: str, most: int | None = None, /, **fields: str) -> str:
    """One section: its entries, ranked and counted by key."""
    by = f"PARTITION BY {keys} " if keys else ""
    columns = ", ".join(f"CAST({fields.get(f, 'NULL')} AS {kind}) AS {f}" for f, kind in KINDS.items())
    limit = f" QUALIFY row_number() OVER ({by}ORDER BY {order}) <= {most}" if most else ""
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}'{title}' AS section, row_number() OVER ({by}ORDER BY {order}) AS place, count(*) OVER ({by.strip()}) AS available, {columns} FROM {source}{limit}"


def union(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


RT = "report_date, ticker"
EXTRA = {
    **AUTOMATION,
    "tmoves": "SELECT m.*, g.label, g.status, g.rk, g.signal_eligible AS ok, g.reasons AS why FROM f_moves m JOIN gate g ON g.cik = m.cik WHERE put_call = '' AND ticker IS NOT NULL AND report_date IN (SELECT report_date FROM flow)",
    "theld": "SELECT report_date, ticker, cik, max(label) AS label, round(sum(round(curr_value, 2)), 2) AS v, round(sum(curr_weight), 6) AS w FROM tmoves WHERE ok AND move <> 'EXIT' GROUP BY ALL",
    "tout": "SELECT report_date, ticker, cik, max(label) AS label, max(status) AS status, max(rk) AS rk, max(why) AS why FROM tmoves WHERE NOT ok GROUP BY ALL",
    "tfunds": "SELECT report_date, ticker, count(*) FILTER (o) AS a, count(*) FILTER (NOT o) AS x FROM (SELECT report_date, ticker, cik, bool_or(ok) AS o FROM tmoves GROUP BY ALL) GROUP BY ALL",
    "fnew": "SELECT r.*, q.prev_report_date, p.accession AS prev_accession FROM f_resolved r JOIN latest l ON l.cik = r.cik AND l.q = r.report_date JOIN f_prevq q ON q.accession = r.accession LEFT JOIN f_resolved p ON p.cik = r.cik AND p.report_date = q.prev_report_date",
    "fmov": "SELECT m.* FROM f_moves m JOIN latest l ON l.cik = m.cik AND l.q = m.report_date",
    "fsnap": "SELECT s.* FROM f_snap s JOIN latest l ON l.cik = s.cik AND l.q = s.report_date",
    "lrun": "SELECT watchlist_id, max(run) AS run FROM duelist WHERE error IS NULL GROUP BY 1",
    "topalert": """SELECT watchlist_id, string_agg(ticker || ':' || action, ';' ORDER BY rn) AS t FROM (SELECT watchlist_id, ticker, action,
   row_number() OVER (PARTITION BY watchlist_id ORDER BY CASE action WHEN 'alert' THEN 3 ELSE 2 END DESC, max(run_at) DESC, ticker, action) AS rn FROM raised GROUP BY watchlist_id, ticker, action) WHERE rn <= 3 GROUP BY 1""",
    "fundpage": union(
        part("cik", "filing", "fnew", "accession", name="accession", code="form", day="filing_date", amount="round(total_value, 2)"),
        part("cik", "previous_filing", "fnew WHERE prev_accession IS NOT NULL", "accession", name="prev_accession", day="prev_report_date"),
        part("cik", "positions", "fsnap", "round(value_usd, 2) DESC, cusip, put_call", 25, name="issuer", code="cusip", amount="round(value_usd, 2)", ratio="round(weight, 6)", detail="put_call"),
        part("cik", "moves", "fmov WHERE move <> 'HOLD'", f"{BIG} DESC, cusip, put_call", 25, name="issuer", code="move", amount=BIG, detail=DETAIL),
        part("cik", "counts", "(SELECT cik, move, count(*) AS c FROM fmov GROUP BY ALL)", "move", code="move", n="c"),
        part("cik", "quality", "(SELECT * FROM gate WHERE cik IN (SELECT cik FROM latest))", "status", code="status", n="series_points", detail="reasons"),
        part("cik", "findings", "(SELECT * FROM found WHERE cik IN (SELECT cik FROM latest))", "kind, event_quarter NULLS FIRST, CASE WHEN kind = 'stale_fund' THEN 'high' ELSE detail END", name="kind", code="temporal_scope", day="event_quarter"),
        part("cik", "quarters", "f_resolved", "report_date DESC", 8, day="report_date", amount="round(total_value, 2)", n="n_positions")),
    "errs": "SELECT * FROM ev WHERE status >= 400",
    "closedroutes": f"SELECT key_id, route, method, count(*) AS c, max(tm) AS m, count(*) FILTER (status >= 400) AS e FROM ev WHERE tm >= {NOW} - to_days(7) AND key_id IN (SELECT key_id FROM close) GROUP BY ALL",
}

SQL = {
    "v5_fund_series": """SELECT f.cik, f.label, count(r.cik) AS n0, CASE WHEN count(r.cik) > 0 THEN count(r.cik) END AS n_quarters, string_agg(r.report_date || '=' || r.n_positions, ';' ORDER BY r.report_date) AS positions_by_quarter,
  round(sum(round(r.total_value, 2)), 2) AS value_of_all_quarters, arg_max(round(r.total_value, 2), r.report_date) AS newest_value FROM funds f LEFT JOIN resolved r ON r.cik = f.cik GROUP BY f.cik, f.label""",
    "v6_fund_page": "SELECT * FROM fundpage",
    "p18_page_windows": "SELECT cik, section, count(*) AS returned, max(available) AS available FROM fundpage GROUP BY ALL",
    "v7_ticker_page": union(
        part(RT, "score", "flow", "score", amount="score", code="action", detail="triggers"),
        part(RT, "confidence", "tfunds", "a", code="CASE WHEN x = 0 THEN 'ok' ELSE 'partial' END", ratio="round(a / (a + x), 6)", n="a", detail="a || ' trusted, ' || x || ' excluded'"),
        part(RT, "holders", "theld", "v DESC, cik", 10, name="label", code="cik", amount="v", ratio="w"),
        part(RT, "movements", "(SELECT * FROM tmoves WHERE ok AND move <> 'HOLD')", f"{BIG} DESC, cik, cusip", 10, name="label", code="move", amount=BIG, detail=DETAIL),
        part(RT, "excluded", "tout", "rk DESC, cik", None, name="label", code="status", detail="why")),
    "v8_preview_links": """SELECT w.ticker, coalesce(action, 'blocked') AS action, '/stocks/' || w.ticker AS page, '/api/stocks/' || w.ticker AS data
 FROM (SELECT DISTINCT ticker FROM wl) w LEFT JOIN nflow f ON f.ticker = w.ticker""",
    "a22_health_sections": union(
        part("", "usage", "usage", "day_used DESC, minute_used DESC, created_at DESC, key_id", 25, name="key_id", code="tier", n="day_used", amount="minute_used"),
        part("", "routes", "(SELECT route, count(*) AS c, max(tm) AS m FROM ev GROUP BY route)", "m DESC, route", 15, name="route", n="c", at=T.format("m")),
        part("", "recent_errors", "errs", "tm DESC, id DESC", 10, name="route", code="method", n="status", at=T.format("tm"), detail="key_id"),
        part("", "recent_keys", "api_keys", "created_at DESC, key_id", 10, name="key_id", code="tier", at=T.format("created_at")),
        part("", "workspace", """(SELECT 'watchlists' AS k, count(*) AS c, NULL::TIMESTAMP AS m FROM watchlists UNION ALL SELECT 'signal_snapshots', count(*), max(created_at) FROM wsnaps
          UNION ALL SELECT 'alerts', count(*), max(last_seen_at) FROM walerts UNION ALL SELECT 'open_alerts', count(*), NULL FROM walerts WHERE status = 'open')""", "k", name="k", n="c", at=T.format("m"))),
    "a24_closeout_sections": union(
        part("key_id", "routes", "closedroutes", "c DESC, m DESC, route, method", 10, name="route", code="method", n="c", amount="e", at=T.format("m")),
        part("key_id", "top_alerts", "(SELECT * FROM walerts WHERE key_id IN (SELECT key_id FROM close))", "severity DESC, last_seen_at DESC, ticker, alert_id", 5,
             name="ticker", code="action", n="severity", detail="status", at=T.format("last_seen_at"))),
    "a24_closeout_reason": f"""SELECT verdict, CASE WHEN keys = 0 THEN 'no key was used in the window' WHEN server_errors > 0 THEN 'server errors in the window' WHEN ok = 0 THEN 'no request succeeded'
  WHEN lifecycle_actions > 0 THEN 'a key has to be renewed before more use' WHEN verdict = 'expand_candidate' THEN 'repeated use with saved work' ELSE 'used, but too little to go on' END AS reason FROM ({WORKSPACE_SQL['a24_closeout_verdict']})""",
    "a27_sample_accessions": part("", "accessions", "(SELECT * FROM resolved WHERE report_date = (SELECT max(report_date) FROM resolved))", "filing_date DESC, accession", 5, name="accession", code="cik", day="filing_date", n="n_positions"),
    "v11_report_deltas": f"""SELECT watchlist_id, {T.format('run_at')} AS created_at, run > 0 AS has_baseline, coalesce(n, 0) AS signals, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
  coalesce(acted, 0) AS changed_actions, coalesce(rescored, 0) AS changed_scores, t AS top_alerts
 FROM lrun JOIN ticks USING (run) LEFT JOIN perlist USING (run, watchlist_id) LEFT JOIN moved USING (run, watchlist_id) LEFT JOIN topalert USING (watchlist_id)""",
    "k12_nested_export": WORKSPACE_SQL["k12_workspace_export"],
}
SQL["v5_fund_series"] = f"SELECT * EXCLUDE (n0) FROM ({SQL['v5_fund_series']})"


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
