"""SQL for the price and valuation queries."""

from oracles.base import BNO, sql, tick

TODAY = "DATE '2027-11-01'"
EXTRA = {
    "fund_am": f"SELECT {tick(BNO)} AS ticker, sum(p_retailprice) AS market_cap, CAST(sum(p_size) AS DOUBLE) AS so FROM part GROUP BY ALL",
    "nowpx": f"SELECT ticker, max(date) AS price_date, arg_max(adj_close, date) AS px FROM prices WHERE date BETWEEN {TODAY} - 10 AND {TODAY} GROUP BY ticker",
    "basis": """SELECT s.ticker, s.report_date, p.adj_close AS px FROM (SELECT DISTINCT ticker, report_date FROM snap WHERE ticker IS NOT NULL) s
 ASOF JOIN prices p ON p.ticker = s.ticker AND p.date <= s.report_date WHERE p.date >= s.report_date - 7""",
    "valued": """SELECT *, sum(cv) OVER (PARTITION BY accession) AS tot FROM (
 SELECT s.accession, s.cusip, s.put_call, s.value_usd, s.shares, f.market_cap, f.so, b.px AS bpx, n.px AS npx,
  CASE WHEN s.put_call <> '' THEN 'option' WHEN s.ticker IS NULL THEN 'no_ticker' WHEN b.px IS NULL OR n.px IS NULL THEN 'no_price' ELSE 'priced' END AS status,
  CASE WHEN s.put_call = '' AND s.ticker IS NOT NULL AND b.px IS NOT NULL AND n.px IS NOT NULL THEN s.shares * n.px ELSE s.value_usd END AS cv,
  CASE WHEN s.put_call = '' AND s.ticker IS NOT NULL AND b.px IS NOT NULL AND n.px IS NOT NULL THEN s.shares * b.px END AS bv
 FROM snap s LEFT JOIN basis b ON b.ticker = s.ticker AND b.report_date = s.report_date LEFT JOIN nowpx n ON n.ticker = s.ticker
 LEFT JOIN fund_am f ON f.ticker = s.ticker)""",
    "rawpx": f"""SELECT CASE WHEN l_linenumber = 7 AND l_quantity = 50 THEN '' ELSE {tick(BNO)} END AS t,
  CASE WHEN l_linenumber = 6 AND l_quantity = 49 THEN NULL ELSE CAST(l_shipdate + INTERVAL 26 YEAR AS DATE) END AS d,
  CASE WHEN l_linenumber = 5 AND l_quantity = 48 THEN NULL ELSE l_extendedprice END AS px
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "goodpx": "SELECT t AS ticker, d AS date, count(*) AS copies FROM rawpx WHERE t <> '' AND d IS NOT NULL AND px > 0 GROUP BY ALL",
    "gaps": "SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM {}",
}
EXTRA["pgaps"] = EXTRA["gaps"].format("prices")
EXTRA["ggaps"] = EXTRA["gaps"].format("goodpx")
del EXTRA["gaps"]


def history(table: str) -> str:
    return f"""SELECT u.ticker, coalesce(n, 0) AS n_days, first_date, last_date,
  coalesce(first_date > DATE '2021-01-04', false) AS missing_start, coalesce(last_date < DATE '2027-10-30', false) AS missing_end,
  CASE WHEN n IS NULL THEN 'empty' WHEN first_date > DATE '2021-01-04' OR last_date < DATE '2027-10-30' THEN 'partial' ELSE 'complete' END AS history
 FROM (SELECT ticker FROM fund_am UNION SELECT 'ZZZ') u
 LEFT JOIN (SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM {table} GROUP BY 1) p USING (ticker)"""


SQL = {
    "j4_price_asof": """SELECT m.ticker, m.as_of, p.date AS price_date, round(p.adj_close, 6) AS price
 FROM (SELECT DISTINCT ticker, last_day(date) AS as_of FROM prices) m ASOF JOIN prices p ON p.ticker = m.ticker AND p.date <= m.as_of
 WHERE p.date >= m.as_of - 7""",
    "j4_latest_close": "SELECT ticker, price_date, round(px, 6) AS price FROM nowpx",
    "j10_forward_returns": """, num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM prices),
 pts AS (SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) + 6 AS as_of FROM prices),
 st AS (SELECT pts.ticker, as_of, min(i) + 1 AS e FROM pts JOIN num ON num.ticker = pts.ticker AND num.date >= as_of GROUP BY ALL)
 SELECT st.ticker, as_of, n0.date AS execution_timestamp, round(n0.adj_close, 6) AS adjusted_entry_price,
  round(coalesce(n3.adj_close, n2.adj_close, n1.adj_close), 6) AS adjusted_exit_price,
  round(n1.adj_close / n0.adj_close - 1, 8) AS forward_return_20d, round(n2.adj_close / n0.adj_close - 1, 8) AS forward_return_60d,
  round(n3.adj_close / n0.adj_close - 1, 8) AS forward_return_120d
 FROM st JOIN num n0 ON n0.ticker = st.ticker AND n0.i = e LEFT JOIN num n1 ON n1.ticker = st.ticker AND n1.i = e + 20
 LEFT JOIN num n2 ON n2.ticker = st.ticker AND n2.i = e + 60 LEFT JOIN num n3 ON n3.ticker = st.ticker AND n3.i = e + 120""",
    "j17_fundamentals_join": "SELECT accession, cusip, round(market_cap, 2) AS market_cap, round(shares / so, 6) AS pct_of_company FROM valued WHERE status = 'priced'",
    "v1_portfolio_valuation": """SELECT accession, cusip, put_call, status, round(cv, 2) AS current_value, round(cv / tot, 6) AS current_weight,
  round(cv - bv, 2) AS pnl_abs, round(CASE WHEN status = 'priced' THEN npx / bpx - 1 END, 6) AS pnl_pct, round(value_usd / bv, 5) AS reconcile_ratio FROM valued""",
    "v1_valuation_totals": """SELECT accession, round(sum(value_usd), 2) AS reported_total, round(sum(cv), 2) AS current_total,
  round(coalesce(sum(bv), 0), 2) AS priced_basis_total, round(coalesce(sum(cv) FILTER (status = 'priced'), 0), 2) AS priced_current_total,
  round(coalesce(sum(cv) FILTER (status = 'priced'), 0) - coalesce(sum(bv), 0), 2) AS pnl_abs,
  round(sum(cv) - coalesce(sum(cv) FILTER (status = 'priced'), 0), 2) AS unpriced_value,
  round((coalesce(sum(cv) FILTER (status = 'priced'), 0) - coalesce(sum(bv), 0)) / sum(bv), 6) AS pnl_pct FROM valued GROUP BY ALL""",
    "f24_valuation_status": "SELECT status, count(*) AS n FROM valued GROUP BY status",
    "l1_top_by_current_value": """SELECT accession, row_number() OVER w AS position_rank, cusip, put_call, round(cv, 2) AS current_value FROM valued
 WINDOW w AS (PARTITION BY accession ORDER BY round(cv, 2) DESC, cusip, put_call) QUALIFY row_number() OVER w <= 3""",
    "a15_price_validation": f""", h AS ({history('goodpx')}), g AS (SELECT ticker, max(date - prev) AS gap FROM ggaps GROUP BY ticker)
 SELECT *, CASE WHEN invalid_rows + duplicate_rows + tickers_empty + tickers_partial_history + major_gaps > 0 THEN 'review' ELSE 'ready' END AS status FROM (SELECT
  (SELECT count(*) FROM rawpx) AS rows_total, (SELECT count(*) FROM rawpx WHERE t = '' OR d IS NULL OR px IS NULL) AS invalid_rows,
  (SELECT count(*) FROM goodpx) AS rows_valid, (SELECT CAST(sum(copies) - count(*) AS BIGINT) FROM goodpx) AS duplicate_rows,
  (SELECT count(DISTINCT ticker) FROM goodpx) AS tickers_observed, (SELECT count(*) FROM h) AS ticker_universe_count,
  (SELECT count(*) FROM h WHERE history = 'empty') AS tickers_empty, (SELECT count(*) FROM h WHERE history = 'partial') AS tickers_partial_history,
  (SELECT count(*) FROM g WHERE gap > 3) AS major_gaps, (SELECT min(first_date) FROM h) AS earliest_price_date, (SELECT max(last_date) FROM h) AS latest_price_date)""",
    "a15_price_row_problems": """SELECT 'missing_ticker' AS problem, count(*) AS n FROM rawpx WHERE t = '' HAVING count(*) > 0
 UNION ALL SELECT 'invalid_date', count(*) FROM rawpx WHERE d IS NULL HAVING count(*) > 0 UNION ALL SELECT 'invalid_adj_close', count(*) FROM rawpx WHERE px IS NULL HAVING count(*) > 0""",
    "l10_report_samples": f""", bad AS (SELECT {tick(BNO)} AS tk, l_linenumber AS n, l_quantity AS q, CAST(CAST(l_shipdate + INTERVAL 26 YEAR AS DATE) AS VARCHAR) AS d FROM lineitem JOIN part ON p_partkey = l_partkey
   WHERE (l_linenumber = 7 AND l_quantity = 50) OR (l_linenumber = 6 AND l_quantity = 49) OR (l_linenumber = 5 AND l_quantity = 48))
 SELECT 'invalid_row' AS sample, CASE WHEN n = 7 THEN '' ELSE tk END AS ticker, CASE WHEN n = 6 THEN 'soon' ELSE d END AS date, CASE n WHEN 7 THEN 'missing_ticker' WHEN 6 THEN 'invalid_date' ELSE 'invalid_adj_close' END AS detail
  FROM bad
 UNION ALL SELECT 'major_gap', ticker, CAST(prev AS VARCHAR), CAST(date - prev AS VARCHAR) FROM (SELECT * FROM pgaps WHERE prev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date - prev DESC, prev) = 1) WHERE date - prev > 3""",
    "u1_price_provider": f"""SELECT s.ticker, s.as_of, o.date AS price_date, o.px AS price FROM (SELECT DISTINCT ticker, report_date AS as_of FROM snap WHERE ticker IS NOT NULL) s
 ASOF JOIN (SELECT {tick("CAST(o_custkey % 25 + 1 AS VARCHAR)")} AS ticker, CAST(o_orderdate + INTERVAL 26 YEAR AS DATE) AS date, max(o_totalprice) AS px FROM orders GROUP BY ALL) o ON o.ticker = s.ticker AND o.date <= s.as_of
 WHERE o.date >= s.as_of - 7""",
    "a16_history_coverage": f"SELECT * FROM ({history('prices')}) WHERE ticker <> 'ZZZ'",
    "w9_largest_gap": """SELECT u.ticker, g.date - g.prev AS max_gap_days, g.prev AS gap_from, g.date AS gap_to FROM fund_am u LEFT JOIN (
  SELECT * FROM pgaps WHERE prev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date - prev DESC, prev) = 1) g ON g.ticker = u.ticker""",
    "k6_merge_prices": "SELECT ticker, date, round(CASE WHEN ticker < 'TC' THEN adj_close ELSE adj_close + 1 END, 6) AS adj_close FROM prices",
    "k6_merge_prices_forced": "SELECT ticker, date, round(CASE WHEN date < DATE '2025-01-01' THEN adj_close ELSE adj_close + 1 END, 6) AS adj_close FROM prices",
    "w15_dedupe_last_wins": "SELECT ticker, count(*) AS kept, CAST(sum(copies - 1) AS BIGINT) AS dropped FROM goodpx GROUP BY ticker",
}


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
