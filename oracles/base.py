"""Shared pieces of the checking SQL: the domain tables over the driver's views."""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-01-20 12:00:00'"
BNO = "regexp_extract(p_brand, '[0-9]+')"


def tick(no: str) -> str:
    return f"('T' || translate({no}, '0123456789', 'ABCDEFGHIJ'))"


LINE_COLS = """
 SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik,
   CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) + INTERVAL 26 YEAR AS DATE) AS report_date,
   CASE WHEN l_linestatus = 'O' AND NOT (l_suppkey % 3 = 0 AND l_linenumber > 2) THEN '13F-HR/A' ELSE '13F-HR' END AS form,
   'BR' || lpad({no}, 4, '0') || '100' AS cusip,
   CASE WHEN CAST({no} AS INT) % 8 <> 5 THEN {tk} END AS ticker,
   p_name AS issuer, p_type AS title_of_class,
   CASE WHEN l_returnflag = 'R' THEN 'Put' ELSE '' END AS put_call,
   l_extendedprice AS value, l_quantity AS shares
 FROM lineitem JOIN part ON p_partkey = l_partkey
""".format(no=BNO, tk=tick(BNO))

FILED = """
 SELECT *, cik || '|' || CAST(report_date AS VARCHAR) || '|' || form AS accession,
   CAST(report_date + CAST(CASE WHEN form = '13F-HR' THEN 45 ELSE 75 END AS INTEGER) AS DATE) AS filing_date
 FROM ({})
"""

FLAWED = """
 SELECT cik,
   CAST(CASE WHEN report_date = DATE '2027-12-31' AND fund % 9 = 4 THEN DATE '2027-09-30'
        WHEN month(report_date) = 6 AND fund % 7 = 0 THEN last_day(CAST(report_date - INTERVAL 3 MONTH AS DATE))
        ELSE report_date END AS DATE) AS report_date,
   CASE WHEN thin THEN '13F-HR/A' ELSE form END AS form,
   CASE WHEN thin THEN 'BR000' || CAST(CAST(substr(cusip, 3, 4) AS INT) % 3 AS VARCHAR) || '100' ELSE cusip END AS cusip,
   ticker, issuer, title_of_class,
   CASE WHEN thin THEN '' ELSE put_call END AS put_call,
   value * CASE WHEN report_date = DATE '2027-09-30' AND fund % 10 = 1 THEN 1000.0::DOUBLE
     WHEN report_date = DATE '2025-06-30' AND fund % 10 = 2 THEN 0.001::DOUBLE
     WHEN report_date = DATE '2027-12-31' AND fund % 10 = 3 THEN 300.0::DOUBLE
     WHEN report_date = DATE '2027-12-31' AND fund % 10 = 5 THEN 0.0005::DOUBLE ELSE 1.0::DOUBLE END AS value,
   shares
 FROM (SELECT *, CAST(cik AS BIGINT) AS fund, report_date = DATE '2027-12-31' AND CAST(cik AS BIGINT) % 11 = 7 AS thin FROM ({}))
""".format(LINE_COLS)

# name -> SQL body; a body may use any name defined before it.
CTES: dict[str, str] = {}


def _filing_ctes(p: str, lines: str) -> None:
    CTES[f"{p}lines"] = FILED.format(lines)
    CTES[f"{p}positions"] = f"""
 SELECT accession, cik, report_date, form, filing_date, cusip, put_call,
   min(issuer) AS issuer, min(title_of_class) AS title_of_class, max(ticker) AS ticker,
   sum(value * CASE WHEN filing_date < DATE '2023-01-03' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END) AS value_usd,
   sum(shares) AS shares
 FROM {p}lines GROUP BY ALL"""
    CTES[f"{p}filings"] = f"""
 SELECT accession, cik, report_date, form, filing_date, sum(value_usd) AS total_value, count(*) AS n_positions
 FROM {p}positions GROUP BY ALL"""
    CTES[f"{p}resolved"] = f"""
 SELECT f.* FROM {p}filings f
 JOIN (SELECT cik, report_date, max(n_positions) AS m FROM {p}filings GROUP BY ALL) x USING (cik, report_date)
 WHERE f.n_positions >= 0.5 * m
 QUALIFY row_number() OVER (PARTITION BY cik, report_date ORDER BY filing_date DESC, accession DESC) = 1"""
    CTES[f"{p}prevq"] = f"""
 SELECT a.cik, a.report_date, a.accession, (SELECT max(b.report_date) FROM {p}resolved b WHERE b.cik = a.cik AND b.report_date < a.report_date) AS prev_report_date
 FROM {p}resolved a"""
    CTES[f"{p}snap"] = f"""
 SELECT p.*, p.value_usd / r.total_value AS weight
 FROM {p}positions p JOIN {p}resolved r ON r.accession = p.accession"""
    CTES[f"{p}moves"] = f"""
 SELECT *, CASE WHEN ps IS NULL THEN 'NEW' WHEN cs IS NULL THEN 'EXIT'
     WHEN abs(CASE WHEN ps <> 0 THEN (cs - ps) / ps ELSE 0 END) <= 0.005 THEN 'HOLD'
     WHEN cs > ps THEN 'ADD' ELSE 'TRIM' END AS move,
   coalesce(ps, 0) AS prev_shares, coalesce(cs, 0) AS curr_shares,
   coalesce(pv, 0) AS prev_value, coalesce(cv, 0) AS curr_value, coalesce(cw, 0) AS curr_weight,
   CASE WHEN ps <> 0 THEN (coalesce(cs, 0) - ps) / ps END AS share_change_pct
 FROM (
  SELECT coalesce(c.cik, p.cik) AS cik, coalesce(c.report_date, p.q) AS report_date,
    coalesce(c.cusip, p.cusip) AS cusip, coalesce(c.put_call, p.put_call) AS put_call,
    coalesce(c.issuer, p.issuer) AS issuer, coalesce(c.ticker, p.ticker) AS ticker,
    coalesce(c.title_of_class, p.title_of_class) AS title_of_class,
    p.shares AS ps, c.shares AS cs, p.value_usd AS pv, c.value_usd AS cv, c.weight AS cw
  FROM {p}snap c FULL OUTER JOIN
   (SELECT s.*, n.report_date AS q FROM {p}snap s JOIN {p}prevq n ON n.cik = s.cik AND n.prev_report_date = s.report_date) p
   ON p.cik = c.cik AND p.q = c.report_date AND p.cusip = c.cusip AND p.put_call = c.put_call)"""


_filing_ctes("", LINE_COLS)
CTES["funds"] = "SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS label FROM supplier"
_filing_ctes("f_", FLAWED)
CTES["f_funds"] = """
 SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik,
   CASE WHEN s_suppkey % 13 = 5 THEN (CASE WHEN s_suppkey % 2 = 0 THEN 'Fund  ' ELSE 'fund ' END) || CAST(s_nationkey AS VARCHAR) ELSE s_name END AS label
 FROM supplier
 UNION ALL SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), n_name FROM nation"""
CTES["prices"] = f"""
 SELECT {tick(BNO)} AS ticker, CAST(l_shipdate + INTERVAL 26 YEAR AS DATE) AS date,
   round(avg(l_extendedprice / l_quantity) + 1e-7::DOUBLE, 2) AS adj_close
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"""
CTES["trades"] = f"""
 SELECT {tick(BNO)} AS ticker, lpad({BNO}, 10, '0') AS issuer_cik, p_brand AS issuer_name,
  CAST(o_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS accession,
  CAST(l_shipdate + INTERVAL 26 YEAR AS DATE) + 2 AS filing_date,
  CAST(l_shipdate + INTERVAL 26 YEAR AS DATE) AS transaction_date,
  lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS owner_cik, c_name AS owner_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Chief Executive Officer' WHEN 'MACHINERY' THEN 'CFO' WHEN 'HOUSEHOLD' THEN 'Secretary' ELSE '' END AS officer_title,
  c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS is_officer,
  c_mktsegment = 'AUTOMOBILE' AS is_director, c_mktsegment = 'FURNITURE' AS is_ten_percent_owner,
  CASE WHEN o_orderstatus = 'F' AND l_returnflag = 'R' THEN 'P' WHEN o_orderstatus = 'O' AND l_returnflag = 'R' THEN 'S'
    WHEN o_orderstatus = 'P' THEN 'M' ELSE 'A' END AS transaction_code,
  CASE WHEN o_orderstatus = 'O' AND l_returnflag = 'R' THEN 'D' ELSE 'A' END AS acquired_disposed,
  l_quantity AS shares, l_extendedprice / l_quantity AS price_per_share,
  l_quantity * (1 + p_size / 10.0::DOUBLE) AS shares_owned_after
 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"""
CTES["ev"] = """
 SELECT event_id AS id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS key_id,
  CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/api/' || event_type AS route, event_type AS tool,
  CASE WHEN k < 5 THEN 500 WHEN k < 10 THEN 429 WHEN k < 20 THEN 403 WHEN k < 30 THEN 401 ELSE 200 END AS status,
  ts AS tm, value AS duration_ms, k
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)"""
CTES["telemetry"] = """
 SELECT tm AS ts, CASE tool WHEN 'signup' THEN 'initialize' WHEN 'error' THEN 'http' ELSE 'tool' END AS kind, status, tool,
  (['codex-cli', 'ChatGPT', 'cursor 1.2', 'VS Code; vscode', 'my cline bot', 'mcp-inspector', 'something else'])[k % 7 + 1] AS client,
  status = 200 AS success, duration_ms * 300 AS duration_ms FROM ev"""
CTES["api_keys"] = f"""
 SELECT lpad(CAST(u AS VARCHAR), 6, '0') AS key_id, 'Key ' || CAST(u AS VARCHAR) AS label,
  CASE WHEN u % 9 = 0 THEN 'admin:read read' ELSE 'read' END AS scopes,
  CASE WHEN u % 2 = 0 THEN 'pro' ELSE 'team' END AS tier,
  CAST(u % 4 + 1 AS BIGINT) AS rate_per_min, CAST(CASE WHEN u % 10 = 7 THEN 0 ELSE u % 6 + 2 END AS BIGINT) AS rate_per_day,
  f AS created_at,
  CASE WHEN u % 5 = 1 THEN {NOW} + to_days(CAST(u % 30 - 10 AS INT)) END AS expires_at,
  CASE WHEN u % 3 = 1 THEN {NOW} + to_days(CAST(u % 40 - 15 AS INT)) END AS rotation_due_at,
  CASE WHEN u % 11 = 3 THEN t END AS revoked_at, t AS last_used_at
 FROM (SELECT user_id AS u, min(ts) AS f, max(ts) AS t FROM events GROUP BY 1)"""
CTES["watchlists"] = f"""
 SELECT 'w' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS watchlist_id, lpad(CAST(c_custkey % 150 AS VARCHAR), 6, '0') AS key_id,
  c_name AS name,
  [{tick("CAST(c_custkey % 25 + 1 AS VARCHAR)")}, {tick("CAST((c_custkey + 7) % 25 + 1 AS VARCHAR)")}, {tick("CAST((c_custkey + 13) % 25 + 1 AS VARCHAR)")}] AS tickers,
  c_custkey % 4 <> 3 AS enabled,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'daily' WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') THEN 'weekly' ELSE 'manual' END AS frequency,
  CASE WHEN c_custkey % 3 = 0 THEN ['alert', 'watch'] END AS actions,
  CASE WHEN c_custkey % 5 = 0 THEN ['NEW'] END AS moves,
  CASE WHEN c_custkey % 2 = 0 THEN 40.0::DOUBLE END AS min_score, CASE WHEN c_custkey % 7 = 0 THEN 2 END AS min_holders,
  CASE WHEN c_custkey % 6 = 0 THEN 1 END AS min_buyers, CASE WHEN c_custkey % 8 = 0 THEN 5e6::DOUBLE END AS max_13f_value_usd,
  {NOW} - to_hours(CAST(c_custkey % 500 AS INT)) AS created_at, {NOW} - to_hours(CAST(c_custkey % 97 AS INT)) AS updated_at
 FROM customer"""
CTES["wsnaps"] = f"""
 SELECT 's' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS snapshot_id, 'w' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS watchlist_id,
  lpad(CAST(o_custkey % 150 AS VARCHAR), 6, '0') AS key_id, {NOW} - to_hours(CAST(o_orderkey % 900 + 1 AS INT)) AS created_at
 FROM orders"""
CTES["walerts"] = f"""
 SELECT 'a' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS alert_id, lpad(CAST(o_custkey % 150 AS VARCHAR), 6, '0') AS key_id,
  'w' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS watchlist_id, {tick("CAST(o_orderkey % 25 + 1 AS VARCHAR)")} AS ticker,
  CASE WHEN o_orderkey % 3 = 0 THEN 'alert' ELSE 'watch' END AS action,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'acknowledged' ELSE 'dismissed' END AS status,
  {NOW} - to_hours(CAST(o_orderkey % 700 + 24 AS INT)) AS first_seen_at, {NOW} - to_hours(CAST(o_orderkey % 24 AS INT)) AS last_seen_at
 FROM orders"""


def sql(body: str, **extra: str) -> str:
    """Put the CTEs that ``body`` (and they themselves) use in front of it."""
    known = {**CTES, **extra}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{re.escape(name)}\b", text):
                needed.add(name)
                visit(known[name])

    visit(body)
    ordered = [n for n in known if n in needed]
    if not ordered:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in ordered)
    return head + (body if body.startswith(",") else "\n" + body)
