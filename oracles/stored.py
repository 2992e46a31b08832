"""SQL for stored quarters, the price source, and tables whose old rows end."""

from oracles.base import NOW, sql
from oracles.filings import SQL as FILINGS
from oracles.workspace import EXTRA as WORKSPACE

DAY0 = f"CAST({NOW} - to_days(10) AS DATE)"
EXTRA = {
    **WORKSPACE,
    "counted": """SELECT CASE kind WHEN 'tool' THEN 'tool' ELSE 'client' END AS kind, CASE kind WHEN 'tool' THEN tool ELSE family END AS name, day, kind = 'tool' AS t, success, ms FROM tele WHERE kind IN ('tool', 'initialize')""",
}

SQL = {
    "p5_stored_range": FILINGS["p5_quarter_range"],
    "j3_stored_diff": FILINGS["j3_latest_diff"],
    "j16_stored_holders": """SELECT report_date, cusip, count(*) AS holders, round(sum(value_usd), 2) AS value_usd FROM snap WHERE put_call = '' AND report_date = (SELECT max(report_date) FROM resolved) GROUP BY ALL""",
    "st6_pruned_audit": f"""SELECT count(*) AS before, count(*) FILTER (tm >= {NOW} - to_days(10)) AS after, count(*) FILTER (tm < {NOW} - to_days(10)) AS deleted,
  count(DISTINCT CAST(tm AS DATE)) FILTER (CAST(tm AS DATE) < {DAY0}) AS days_dropped FROM ev""",
    "st7_family_counters": """SELECT kind, name, day, count(*) AS calls, count(*) FILTER (success) AS successes, CAST(sum(CASE WHEN t THEN ms ELSE 0 END) AS BIGINT) AS duration_ms,
  CAST(max(CASE WHEN t THEN ms ELSE 0 END) AS BIGINT) AS max_ms FROM counted WHERE day >= (SELECT max(day) - 13 FROM counted) GROUP BY ALL""",
}
PRICES = """WITH d AS (SELECT * FROM prices WHERE date BETWEEN DATE '2022-01-01' AND DATE '2023-12-31'),
 p AS (SELECT DISTINCT ticker, CAST(last_day(date) AS DATE) AS as_of FROM d)
 SELECT p.ticker, p.as_of, max(d.date) AS price_date, round(arg_max(d.adj_close, d.date), 6) AS price FROM p JOIN d ON d.ticker = p.ticker AND d.date <= p.as_of AND d.date >= p.as_of - 7 GROUP BY ALL"""
SQL["u1_price_source"] = f"SELECT * FROM ({PRICES})"


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
