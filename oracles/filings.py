"""SQL for the filing, move and consensus queries."""

from oracles.base import sql

SIZE = """CASE WHEN move IN ('NEW', 'EXIT', 'HOLD') THEN greatest(round(curr_value, 2), round(prev_value, 2))
  ELSE abs(coalesce(round(share_change_pct, 9), 0)) END"""
USD = """CASE WHEN abs({x}) >= 1e9 THEN '$' || format('{{:,.1f}}', round({x} / 1e9, 1)) || 'B'
  WHEN abs({x}) >= 1e6 THEN '$' || format('{{:,.1f}}', round({x} / 1e6, 1)) || 'M'
  WHEN abs({x}) >= 1e3 THEN '$' || format('{{:,.1f}}', round({x} / 1e3, 1)) || 'K'
  ELSE '$' || format('{{:,.0f}}', round({x}, 0)) END"""


def usd(x: str) -> str:
    return USD.format(x=x)


DETAIL = f"""CASE WHEN move = 'NEW' THEN 'NEW ' || {usd('round(curr_value, 2)')}
  WHEN move = 'EXIT' THEN 'EXIT ' || {usd('round(prev_value, 2)')}
  WHEN share_change_pct IS NULL THEN move
  ELSE CASE WHEN share_change_pct < 0 THEN '-' ELSE '+' END || CAST(abs(CAST(round(round(share_change_pct, 9) * 100, 0) AS BIGINT)) AS VARCHAR) || '% shares' END
  || CASE WHEN put_call <> '' THEN ' [' || put_call || ']' ELSE '' END"""

CONSENSUS = """SELECT report_date, cusip, max(ticker) AS ticker, max(issuer) AS issuer, count(DISTINCT cik) AS n_funds,
  round(sum(value_usd), 2) AS total_value, string_agg(DISTINCT label, ',' ORDER BY label) AS funds
 FROM snap JOIN funds USING (cik) WHERE put_call = '' GROUP BY ALL HAVING count(DISTINCT cik) >= 3"""

SQL = {
    "a1_portfolio_positions": """SELECT accession, cusip, put_call, issuer, title_of_class, round(value_usd, 2) AS value_usd, shares,
  round(value_usd / sum(value_usd) OVER (PARTITION BY accession), 6) AS weight FROM positions""",
    "a2_filing_totals": "SELECT accession, round(total_value, 2) AS total_value, n_positions FROM filings",
    "w1_resolved_filings": "SELECT cik, report_date, accession, form, filing_date, n_positions FROM resolved",
    "w2_position_weights": "SELECT accession, cusip, put_call, round(weight, 6) AS weight FROM snap",
    "w3_previous_quarter": """SELECT a.cik, a.report_date, a.accession, a.prev_report_date, b.accession AS prev_accession
 FROM f_prevq a LEFT JOIN f_resolved b ON b.cik = a.cik AND b.report_date = a.prev_report_date""",
    "w6_latest_per_fund": """SELECT r.cik, r.report_date AS quarter, r.accession AS current_accession, n.accession AS newest_accession, n.filing_date
 FROM (SELECT * FROM f_resolved QUALIFY row_number() OVER (PARTITION BY cik ORDER BY report_date DESC) = 1) r
 JOIN (SELECT * FROM f_filings QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) = 1) n USING (cik)""",
    "w7_latest_portfolios": """SELECT * FROM (SELECT cik, report_date, accession, row_number() OVER (PARTITION BY cik ORDER BY report_date DESC) AS recency FROM resolved) WHERE recency <= 2""",
    "w10_conviction_timeline": """SELECT cik, cusip, report_date, shares, round(value_usd, 2) AS value_usd, round(weight, 6) AS weight,
  shares - lag(shares) OVER w AS shares_change, row_number() OVER w AS quarter_no
 FROM snap WHERE put_call = '' WINDOW w AS (PARTITION BY cik, cusip ORDER BY report_date)""",
    "w11_value_timeline": """SELECT cik, count(*) AS n_points, string_agg(CAST(report_date AS VARCHAR) || ':' || CAST(CAST(round(round(total_value, 2), 0) AS BIGINT) AS VARCHAR), ',' ORDER BY report_date) AS sparkline
 FROM resolved GROUP BY cik""",
    "p7_preferred_filings": """SELECT cik, report_date, accession, form, quarter_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cik ORDER BY report_date DESC) AS quarter_rank FROM (
   SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY cik, report_date ORDER BY (form LIKE '%/A'), filing_date DESC, accession DESC) = 1))""",
    "p8_latest_originals": """SELECT cik, accession, filing_date, filing_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS filing_rank FROM filings WHERE form = '13F-HR') WHERE filing_rank <= 2""",
    "j1_snapshot_join": """SELECT cik, label, report_date, cusip, put_call, round(value_usd, 2) AS value_usd, shares, round(weight, 6) AS weight FROM snap JOIN funds USING (cik)""",
    "j2_quarter_moves": """SELECT cik, report_date, cusip, put_call, move, prev_shares, curr_shares, round(prev_value, 2) AS prev_value,
  round(curr_value, 2) AS curr_value, round(curr_weight, 6) AS curr_weight, round(share_change_pct, 6) AS share_change_pct FROM moves""",
    "j2_moves_with_gaps": """SELECT cik, report_date, count(*) FILTER (move = 'NEW') AS n_new, count(*) FILTER (move = 'ADD') AS n_add,
  count(*) FILTER (move = 'TRIM') AS n_trim, count(*) FILTER (move = 'EXIT') AS n_exit, count(*) FILTER (move = 'HOLD') AS n_hold FROM f_moves GROUP BY ALL""",
    "j3_latest_diff": """SELECT m.cik, m.report_date, cusip, put_call, move, prev_shares, curr_shares FROM moves m
 JOIN (SELECT cik, max(report_date) AS report_date FROM prevq GROUP BY cik HAVING count(*) > 1) q ON q.cik = m.cik AND q.report_date = m.report_date""",
    "a3_consensus_holdings": CONSENSUS,
    "a4_consensus_buys": """SELECT report_date, cusip, max(ticker) AS ticker, min(issuer) AS issuer, count(*) AS n_funds,
  string_agg(label || ':' || move, ',' ORDER BY label) AS votes
 FROM (SELECT * FROM moves JOIN funds USING (cik) WHERE put_call = '' AND move IN ('NEW', 'ADD')
   QUALIFY row_number() OVER (PARTITION BY report_date, cusip, label ORDER BY cik) = 1)
 GROUP BY ALL HAVING count(*) >= 3""",
    "a4_consensus_sells": """SELECT report_date, cusip, count(DISTINCT label) AS n_funds FROM moves JOIN funds USING (cik)
 WHERE put_call = '' AND move IN ('EXIT', 'TRIM') GROUP BY ALL HAVING count(DISTINCT label) >= 2""",
    "l3_consensus_order": f"""SELECT report_date, row_number() OVER (PARTITION BY report_date ORDER BY n_funds DESC, total_value DESC, cusip) AS place, cusip, n_funds
 FROM ({CONSENSUS})""",
    "a5_coverage": """SELECT cik, CASE WHEN cik IS NOT NULL THEN min(label) END AS fund, max(report_date) AS report_date, count(*) AS n,
  count(ticker) AS n_res, round(sum(value_usd), 2) AS val, round(coalesce(sum(value_usd) FILTER (ticker IS NOT NULL), 0), 2) AS val_res,
  round(coalesce(sum(value_usd) FILTER (ticker IS NOT NULL), 0) / sum(value_usd), 6) AS value_share,
  round(sum(value_usd) - coalesce(sum(value_usd) FILTER (ticker IS NOT NULL), 0), 2) AS value_unresolved
 FROM snap JOIN funds USING (cik) WHERE put_call = '' GROUP BY GROUPING SETS ((cik), ())""",
    "a6_unresolved_tail": """SELECT cusip, max(issuer) AS issuer, round(sum(value_usd), 2) AS value, count(DISTINCT cik) AS n_funds
 FROM snap WHERE put_call = '' AND ticker IS NULL GROUP BY cusip""",
    "a11_move_counts": """SELECT cik, report_date, count(*) FILTER (move = 'NEW') AS n_new, count(*) FILTER (move = 'ADD') AS n_add,
  count(*) FILTER (move = 'TRIM') AS n_trim, count(*) FILTER (move = 'EXIT') AS n_exit, count(*) FILTER (move = 'HOLD') AS n_hold FROM moves GROUP BY ALL""",
    "a11_ticker_summary": """SELECT report_date, ticker, count(*) FILTER (move <> 'EXIT') AS holder_count,
  count(*) FILTER (move IN ('NEW', 'ADD')) AS buyers_count, count(*) FILTER (move IN ('EXIT', 'TRIM')) AS sellers_count,
  count(*) FILTER (move = 'NEW') AS new_positions, count(*) FILTER (move = 'EXIT') AS exits, round(sum(curr_value), 2) AS total_value_usd
 FROM moves WHERE put_call = '' AND ticker IS NOT NULL GROUP BY ALL""",
    "j16_compare_funds": """, now AS (SELECT * FROM snap WHERE put_call = '' AND report_date = (SELECT max(report_date) FROM resolved)
   AND cik IN (SELECT cik FROM resolved WHERE report_date = (SELECT max(report_date) FROM resolved) ORDER BY round(total_value, 2) DESC, cik LIMIT 12)),
 n AS (SELECT cik, count(*) AS n FROM now GROUP BY cik)
 SELECT a.cik AS cik_a, b.cik AS cik_b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS common,
  round(sum(least(a.weight, b.weight)), 6) AS common_weight, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard
 FROM now a JOIN now b ON a.cusip = b.cusip AND a.cik < b.cik JOIN n x ON x.cik = a.cik JOIN n y ON y.cik = b.cik GROUP BY a.cik, b.cik""",
    "j19_holders": """SELECT report_date, cusip, ticker, cik, label AS fund, round(value_usd, 2) AS value_usd, shares, round(weight, 6) AS weight
 FROM snap JOIN funds USING (cik) WHERE put_call = ''""",
    "l1_top_positions": """SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY round(value_usd, 2) DESC, cusip, put_call) AS position_rank,
  cusip, put_call, round(value_usd, 2) AS value_usd FROM snap
 QUALIFY row_number() OVER (PARTITION BY accession ORDER BY round(value_usd, 2) DESC, cusip, put_call) <= 5""",
    "l2_moves_by_size": f"""SELECT cik, report_date, move, row_number() OVER (PARTITION BY cik, report_date, move ORDER BY {SIZE} DESC, cusip, put_call) AS move_rank, cusip, put_call FROM moves""",
    "w16_top_moves": f"""SELECT * FROM (SELECT cik, report_date, move, row_number() OVER (PARTITION BY cik, report_date, move ORDER BY {SIZE} DESC, cusip, put_call) AS move_rank,
  cusip, put_call, {DETAIL} AS detail FROM moves WHERE move <> 'HOLD') WHERE move_rank <= 3""",
    "p3_long_only": "SELECT report_date, count(*) AS n, sum(shares) AS shares FROM snap WHERE put_call = '' GROUP BY ALL",
    "p4_fund_set_filter": """, chosen AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_nationkey =
   (SELECT s_nationkey FROM supplier GROUP BY 1 ORDER BY count(*) DESC, s_nationkey DESC LIMIT 1))
 SELECT report_date, count(*) AS filings, CAST(sum(n_positions) AS BIGINT) AS positions, 'all' AS funds FROM resolved GROUP BY ALL
 UNION ALL SELECT report_date, count(*), CAST(sum(n_positions) AS BIGINT), 'chosen' FROM resolved WHERE cik IN (SELECT cik FROM chosen) GROUP BY ALL""",
    "p5_quarter_range": "SELECT cik, report_date, accession FROM resolved WHERE report_date BETWEEN DATE '2023-03-31' AND DATE '2024-12-31'",
    "p1_value_units": """SELECT report_date, form, CASE WHEN filing_date >= DATE '2023-01-03' THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END AS multiplier, count(*) AS n,
  round(sum(value * CASE WHEN filing_date >= DATE '2023-01-03' THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END), 2) AS value_usd FROM lines GROUP BY ALL""",
    "p2_blank_cusips": """SELECT accession, count(*) AS n_positions, round(sum(v), 2) AS total_value FROM (
  SELECT accession, cusip, put_call, sum(value * CASE WHEN filing_date < DATE '2023-01-03' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END) AS v
  FROM lines WHERE title_of_class <> 'PROMO' GROUP BY ALL) GROUP BY accession""",
    "o2_union_of_keys": """SELECT cik, report_date, count(*) AS n_keys FROM (
  SELECT cik, report_date, cusip, put_call FROM snap
  UNION SELECT s.cik, q.report_date, s.cusip, s.put_call FROM snap s JOIN prevq q ON q.cik = s.cik AND q.prev_report_date = s.report_date) GROUP BY ALL""",
    "o5_distinct_sets": """SELECT DISTINCT 'quarter' AS kind, CAST(report_date AS VARCHAR) AS value FROM snap
 UNION ALL SELECT DISTINCT 'ticker', ticker FROM snap WHERE ticker IS NOT NULL""",
}


def build() -> dict[str, str]:
    return {name: sql(body) for name, body in SQL.items()}
