"""SQL for the insider, score and feature queries."""

from oracles.base import BNO, sql, tick
from oracles.filings import USD

D0 = "0.0::DOUBLE"


def sat(n: str, half: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {n} / ({n} + {half}::DOUBLE) ELSE {D0} END)"


def activity(points: str, window: str = "90", key: str = "ticker, as_of") -> dict[str, str]:
    p = points
    return {
        f"{p}_vis": f"""SELECT p.*, t.* EXCLUDE (ticker), p.as_of - t.transaction_date AS age FROM {p} p JOIN tr t
  ON t.ticker = p.ticker AND t.filing_date <= p.as_of AND t.transaction_date BETWEEN p.as_of - {window} AND p.as_of""",
        f"{p}_own": f"""SELECT {key}, owner_cik, count(*) AS n_rows, count(*) FILTER (buy) AS nb, count(*) FILTER (sell) AS ns,
  coalesce(sum(v) FILTER (buy), 0) AS bv, coalesce(sum(v) FILTER (sell), 0) AS sv,
  sum(CASE WHEN buy THEN w * pow(0.5, age / 30.0::DOUBLE) ELSE 0 END) AS units, sum(CASE WHEN buy THEN v * pow(0.5, age / 30.0::DOUBLE) ELSE 0 END) AS rv,
  max(stake) FILTER (buy) AS stake, min(age) FILTER (buy) AS last_age, any_value(is_c) AS is_c, any_value(owner_name) AS owner_name, any_value(role) AS role
 FROM {p}_vis GROUP BY {key}, owner_cik""",
        f"{p}_act": f"""SELECT {key}, CAST(sum(n_rows) AS BIGINT) AS n_visible, count(*) FILTER (nb > 0) AS n_buyers, count(*) FILTER (ns > 0) AS n_sellers,
  count(*) FILTER (nb > 0 AND is_c) AS n_c_suite_buyers, count(*) FILTER (nb > 0 AND last_age <= 14) AS recent_cluster_n,
  min(last_age) AS days_since_last_buy, sum(bv) AS buy_value_usd, sum(sv) AS sell_value_usd, round(sum(units), 4) AS conviction_units,
  round(sum(rv), 2) AS recency_weighted_buy_usd, round(coalesce(max(stake), 0), 4) AS max_stake_increase_pct FROM {p}_own GROUP BY {key}""",
    }


def scored(source: str) -> str:
    """Score every row of a relation that carries both sides, nulls counting as neutral."""
    return f"""SELECT *, greatest(0.0, least(100.0, institutional_score + insider_score + dollar_score + agreement_score + penalty_score)) AS score,
  {sat('abs(nf)', '3')} * sign(nf) AS x, {sat('abs(nbuy - nsell)', '2')} * sign(nbuy - nsell) AS y,
  CASE WHEN fb AND ib THEN 'conviction' WHEN nf < 0 AND isell THEN 'distribution' WHEN (fb AND isell) OR (nf < 0 AND ib) THEN 'divergent'
   WHEN fb THEN 'institutional' WHEN ib THEN 'insider' ELSE 'neutral' END AS quadrant FROM (
 SELECT *, fa - ft AS nf, fa > 0 AND fa >= ft AS fb, nbuy > 0 AND bval >= sval AS ib, bval < sval AND sval > 0 AS isell,
  36.0::DOUBLE * {sat('(fa * (1 + 0.5 * ' + sat('cf', '2') + ' + 0.5 * least(1.0::DOUBLE, aw / 5)))', '1.5')} AS institutional_score,
  36.0::DOUBLE * {sat('cu', '1.2')} AS insider_score,
  CASE WHEN rw > 0 THEN least(18.0::DOUBLE * log10(rw + 1) / log10(25000001.0::DOUBLE), 18.0::DOUBLE) ELSE {D0} END AS dollar_score,
  CASE WHEN fa > 0 AND nbuy > 0 THEN 18.0::DOUBLE * (0.5 + 0.5 * greatest(CASE WHEN dl <= 0 THEN 1 ELSE pow(0.5, dl / 30.0::DOUBLE) END, {sat('rc', '1')})) ELSE {D0} END AS agreement_score,
  -((CASE WHEN ft > fa THEN 14.0::DOUBLE * {sat('ft', '3')} ELSE {D0} END) + (CASE WHEN sval > bval AND sval > 0 THEN 14.0::DOUBLE * {sat('nsell', '2')} ELSE {D0} END)) AS penalty_score
 FROM (SELECT *, coalesce(funds_accumulating, 0) AS fa, coalesce(funds_trimming, 0) AS ft, coalesce(conviction_funds, 0) AS cf, coalesce(avg_weight_pct, 0) AS aw,
  coalesce(n_buyers, 0) AS nbuy, coalesce(n_sellers, 0) AS nsell, coalesce(buy_value_usd, 0) AS bval, coalesce(sell_value_usd, 0) AS sval,
  coalesce(conviction_units, 0) AS cu, coalesce(recency_weighted_buy_usd, 0) AS rw, coalesce(days_since_last_buy, 999) AS dl, coalesce(recent_cluster_n, 0) AS rc
  FROM {source}))"""


SHORT = """CASE WHEN {x} >= 1e6 THEN '$' || format('{{:.1f}}', round({x} / 1e6, 1)) || 'M' WHEN {x} >= 1e3 THEN '$' || format('{{:.0f}}', round({x} / 1e3, 0)) || 'K'
 ELSE '$' || format('{{:.0f}}', round({x}, 0)) END"""
LABEL = """CASE quadrant WHEN 'conviction' THEN 'Conviction' WHEN 'institutional' THEN 'Institutional bid' WHEN 'insider' THEN 'Insider conviction'
 WHEN 'distribution' THEN 'Distribution' WHEN 'divergent' THEN 'Divergent' ELSE 'Neutral' END"""
FRESH = "CASE WHEN days_since_last_buy IS NOT NULL AND nbuy > 0 THEN ', last ' || days_since_last_buy || ' day(s) before' ELSE '' END"
RATIONALE = f"""CASE quadrant WHEN 'conviction' THEN 'Both sides buy: ' || fa || ' fund(s) built up while ' || nbuy || ' insider(s) spent ' || {SHORT.format(x='bval')}
  || CASE WHEN n_c_suite_buyers > 0 THEN ', ' || n_c_suite_buyers || ' of them at the top' ELSE '' END || {FRESH} || '.'
 WHEN 'distribution' THEN 'Both sides sell: funds cut back and insiders sold ' || {SHORT.format(x='sval')} || '.'
 WHEN 'divergent' THEN 'Funds and insiders point in opposite directions.' WHEN 'institutional' THEN fa || ' fund(s) built up; insiders have not bought.'
 WHEN 'insider' THEN nbuy || ' insider(s) spent ' || {SHORT.format(x='bval')} || {FRESH} || '; funds have not followed.'
 ELSE 'Neither side builds up.' END"""
PARTS = "round(score, 6) AS score, round(institutional_score, 6) AS institutional_score, round(insider_score, 6) AS insider_score, round(dollar_score, 6) AS dollar_score, round(agreement_score, 6) AS agreement_score, round(penalty_score, 6) AS penalty_score, round(x, 6) AS x, round(y, 6) AS y"
ACT = """ticker, as_of, n_visible, n_buyers, n_sellers, n_c_suite_buyers, recent_cluster_n, days_since_last_buy, round(buy_value_usd, 2) AS buy_value_usd,
 round(sell_value_usd, 2) AS sell_value_usd, conviction_units, recency_weighted_buy_usd, max_stake_increase_pct"""
SPLIT = """CASE WHEN as_of BETWEEN DATE '2014-01-01' AND DATE '2022-12-31' THEN 'train' WHEN as_of BETWEEN DATE '2023-01-01' AND DATE '2024-12-31' THEN 'validation'
 WHEN as_of BETWEEN DATE '2025-01-01' AND DATE '2026-12-31' THEN 'test' ELSE 'outside' END"""

EXTRA = {
    "tr": """SELECT *, round(shares * price_per_share, 2) AS v, transaction_code = 'P' AND acquired_disposed = 'A' AS buy, transaction_code = 'S' AND acquired_disposed = 'D' AS sell,
  officer_title IN ('Chief Executive Officer', 'CFO') AS is_c, least(shares / (shares_owned_after - shares), 3.0::DOUBLE) AS stake,
  CASE WHEN officer_title <> '' THEN officer_title WHEN is_director THEN 'Director' WHEN is_ten_percent_owner THEN '10% Owner' ELSE 'Insider' END AS role,
  (0.7::DOUBLE + (1.6::DOUBLE - 0.7::DOUBLE) * least(shares / (shares_owned_after - shares), 3.0::DOUBLE) / (least(shares / (shares_owned_after - shares), 3.0::DOUBLE) + 0.1::DOUBLE))
  * CASE WHEN officer_title IN ('Chief Executive Officer', 'CFO') THEN 1.6::DOUBLE WHEN officer_title <> '' THEN 1.2::DOUBLE WHEN is_ten_percent_owner THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS w
 FROM trades""",
    "qpoints": "SELECT DISTINCT ticker, last_day(CAST(date_trunc('quarter', transaction_date) AS DATE) + INTERVAL 2 MONTH) AS as_of FROM trades",
    **activity("qpoints"),
    "inst": """SELECT m.report_date, m.ticker, max(r.filing_date) AS as_of, arg_min(m.issuer, m.cik || m.cusip) AS issuer_name,
  count(*) FILTER (move IN ('NEW', 'ADD')) AS funds_accumulating, count(*) FILTER (move IN ('EXIT', 'TRIM')) AS funds_trimming,
  coalesce(sum(curr_value) FILTER (move IN ('NEW', 'ADD')), 0) AS total_value_usd, coalesce(avg(curr_weight) FILTER (move IN ('NEW', 'ADD')) * 100, 0) AS avg_weight_pct,
  count(*) FILTER (move = 'NEW' OR (move = 'ADD' AND curr_weight >= 0.05)) AS conviction_funds, count(*) AS n_moves,
  string_agg(move, ';' ORDER BY m.cik, m.cusip) AS fund_moves, list_sort(list_distinct(list(r.accession))) AS accs
 FROM moves m JOIN resolved r ON r.cik = m.cik AND r.report_date = m.report_date WHERE put_call = '' AND ticker IS NOT NULL GROUP BY ALL""",
    "fpoints": "SELECT DISTINCT ticker, as_of FROM inst",
    **activity("fpoints"),
    "num": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM prices",
    "st": "SELECT f.ticker, f.as_of, min(i) + 1 AS e FROM fpoints f JOIN num ON num.ticker = f.ticker AND num.date >= f.as_of GROUP BY ALL",
    "rets": """SELECT st.ticker, st.as_of, n0.date AS execution_timestamp, round(n0.adj_close, 6) AS adjusted_entry_price, round(coalesce(n3.adj_close, n2.adj_close, n1.adj_close), 6) AS adjusted_exit_price,
  round(n1.adj_close / n0.adj_close - 1, 8) AS forward_return_20d, round(n2.adj_close / n0.adj_close - 1, 8) AS forward_return_60d, round(n3.adj_close / n0.adj_close - 1, 8) AS forward_return_120d
 FROM st JOIN num n0 ON n0.ticker = st.ticker AND n0.i = e LEFT JOIN num n1 ON n1.ticker = st.ticker AND n1.i = e + 20
 LEFT JOIN num n2 ON n2.ticker = st.ticker AND n2.i = e + 60 LEFT JOIN num n3 ON n3.ticker = st.ticker AND n3.i = e + 120""",
    "feat_in": "SELECT i.*, a.* EXCLUDE (ticker, as_of), r.* EXCLUDE (ticker, as_of) FROM inst i LEFT JOIN fpoints_act a ON a.ticker = i.ticker AND a.as_of = i.as_of LEFT JOIN rets r ON r.ticker = i.ticker AND r.as_of = i.as_of",
    "feats": scored("feat_in"),
    "flat_in": """SELECT i.*, NULL::BIGINT AS n_buyers, NULL::BIGINT AS n_sellers, NULL::DOUBLE AS buy_value_usd, NULL::DOUBLE AS sell_value_usd, NULL::DOUBLE AS conviction_units,
  NULL::DOUBLE AS recency_weighted_buy_usd, NULL::BIGINT AS days_since_last_buy, NULL::BIGINT AS recent_cluster_n FROM inst i""",
    "flats": scored("flat_in"),
    "last_inst": "SELECT * EXCLUDE (as_of) FROM inst WHERE report_date = (SELECT max(report_date) FROM resolved)",
    "dpoints": "SELECT DISTINCT ticker, DATE '2026-06-30' AS as_of FROM trades",
    **activity("dpoints"),
    "now_in": "SELECT coalesce(i.ticker, a.ticker) AS ticker, i.* EXCLUDE (ticker), a.* EXCLUDE (ticker) FROM last_inst i FULL OUTER JOIN dpoints_act a ON a.ticker = i.ticker",
    "nows": scored("now_in"),
    "wpoints": "SELECT DISTINCT ticker, DATE '2026-06-30' AS as_of, w AS window_days FROM trades, (VALUES (30), (90), (180)) v(w)",
    **activity("wpoints", "p.window_days", "ticker, as_of, window_days"),
    "win_in": """SELECT coalesce(i.ticker, a.ticker) AS ticker, coalesce(i.w, a.window_days) AS window_days, i.* EXCLUDE (ticker, w), a.* EXCLUDE (ticker, window_days)
 FROM (SELECT * FROM last_inst, (VALUES (30), (90), (180)) v(w)) i FULL OUTER JOIN wpoints_act a ON a.ticker = i.ticker AND a.window_days = i.w""",
    "wins": scored("win_in"),
    "own_in": f"""SELECT coalesce(i.ticker, c.ticker) AS ticker, i.* EXCLUDE (ticker), c.* EXCLUDE (ticker), NULL::BIGINT AS n_sellers, NULL::DOUBLE AS sell_value_usd, NULL::BIGINT AS recent_cluster_n
 FROM last_inst i FULL OUTER JOIN (SELECT {tick("CAST(c_custkey % 30 + 1 AS VARCHAR)")} AS ticker, count(*) AS n_buyers, round(sum(c_acctbal), 2) AS recency_weighted_buy_usd,
  round(sum(c_acctbal), 2) AS buy_value_usd, 2.0::DOUBLE AS conviction_units, CASE WHEN count(*) > 0 THEN 10 END AS days_since_last_buy FROM customer GROUP BY ALL) c ON c.ticker = i.ticker""",
    "owns": scored("own_in"),
    "f4acc": "SELECT ticker, as_of, list_sort(list_distinct(list(accession))) AS accs FROM fpoints_vis GROUP BY ALL",
}

JSON_LIST = """sha256('["' || array_to_string({}, '","') || '"]')"""

SQL = {
    "a7_insider_activity": f"SELECT {ACT} FROM qpoints_act",
    "j9_visible_trades": "SELECT ticker, as_of, count(*) AS n_trades, count(DISTINCT accession) AS n_filings FROM qpoints_vis GROUP BY ALL",
    "p12_open_market_trades": "SELECT ticker, count(*) FILTER (buy) AS n_buys, count(*) FILTER (sell) AS n_sells, count(*) AS n FROM tr GROUP BY ALL",
    "p14_trade_date_window": """SELECT ticker, transaction_code, count(*) AS n, sum(shares) AS shares FROM trades
 WHERE filing_date BETWEEN DATE '2024-01-01' AND DATE '2025-12-31' AND transaction_date BETWEEN DATE '2024-01-01' AND DATE '2025-12-31' GROUP BY ALL""",
    "st14_trailing_cluster": "SELECT ticker, as_of, count(DISTINCT owner_cik) AS recent_buyers FROM qpoints_vis WHERE buy AND age <= 14 GROUP BY ALL",
    "f3_f8_owner_roles": """SELECT is_c AS c_suite, role, CASE WHEN is_c THEN 1.6::DOUBLE WHEN is_officer THEN 1.2::DOUBLE WHEN is_ten_percent_owner THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS seniority,
 count(*) AS n FROM tr GROUP BY ALL""",
    "f5_f7_curves": """SELECT q AS l_quantity, n AS l_linenumber, round(CASE WHEN q > 10 THEN (q - 10) / (q - 10 + 1.5::DOUBLE) ELSE 0 END, 9) AS saturating,
  round(CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END * q / (q + 3), 9) AS signed, round(CASE WHEN q <= 5 THEN 1 ELSE pow(0.5, (q - 5) / 30.0::DOUBLE) END, 9) AS recency,
  round(s, 9) AS stake, round(CASE WHEN s IS NULL THEN 1 ELSE 0.7::DOUBLE + (1.6::DOUBLE - 0.7::DOUBLE) * s / (s + 0.1::DOUBLE) END, 9) AS sizing
 FROM (SELECT *, CASE WHEN q * n * 3 - 1 > 0 THEN least(q / (q * (1 + n * 3) - 1 - q), 3.0::DOUBLE) END AS s FROM (SELECT DISTINCT l_quantity AS q, l_linenumber AS n FROM lineitem))""",
    "f11_trade_value": "SELECT ticker, round(sum(v), 2) AS value_usd FROM tr GROUP BY ALL",
    "a8_institutional_signals": """SELECT report_date, ticker, as_of, issuer_name, funds_accumulating, funds_trimming, round(total_value_usd, 2) AS total_value_usd,
 round(avg_weight_pct, 6) AS avg_weight_pct, conviction_funds, n_moves FROM inst""",
    "f9_score_pillars": f"SELECT report_date, ticker, {PARTS} FROM feats",
    "f10_quadrants": f"SELECT report_date, ticker, quadrant, {LABEL} AS label, {RATIONALE} AS rationale FROM feats",
    "j5_score_table": f"SELECT ticker, quadrant, fa AS funds_accumulating, nbuy AS n_buyers, {PARTS} FROM nows",
    "p11_min_score_filter": """SELECT '-5' AS floor, ticker, round(score, 6) AS score FROM nows UNION ALL SELECT '70', ticker, round(score, 6) FROM nows WHERE score >= 70
 UNION ALL SELECT '900', ticker, round(score, 6) FROM nows WHERE score >= 100""",
    "l6_signals_by_score": "SELECT ticker, round(score, 6) AS score FROM nows ORDER BY score DESC, ticker",
    "k11_score_windows": f"SELECT window_days, ticker, quadrant, nbuy AS n_buyers, {PARTS} FROM wins",
    "a12_score_kpis": """SELECT window_days, count(*) AS n_signals, count(*) FILTER (quadrant = 'conviction') AS n_conviction, count(*) FILTER (n_c_suite_buyers > 0 AND nbuy >= 2) AS n_csuite_clusters,
  arg_max(ticker, (round(score, 6), ticker)) AS top_ticker, round(max(round(score, 6)), 1) AS top_score, round(sum(bval), 2) AS insider_buy_usd FROM wins GROUP BY ALL""",
    "f28_signal_records": f"""SELECT n.ticker, round(score, 1) AS score, {LABEL} AS quadrant_label, round(x, 4) AS x, round(y, 4) AS y, round(agreement_score, 1) AS agreement,
  round(aw, 2) AS avg_weight_pct, round(cu, 3) AS conviction_units, coalesce(b.buyers, '') AS buyers
 FROM nows n LEFT JOIN (SELECT ticker, string_agg(owner_name || ':' || role || ':' || last_age, ',' ORDER BY bv DESC, owner_name) AS buyers FROM dpoints_own WHERE nb > 0 GROUP BY ticker) b ON b.ticker = n.ticker""",
    "u3_score_provider": f"SELECT ticker, quadrant, {PARTS} FROM owns",
    "v4_feature_table": f"""SELECT report_date, ticker, as_of, '13f_form4_joined' AS feature_scope, {SPLIT} AS split, quadrant,
  CASE WHEN n_visible IS NULL THEN 'no_form4_activity_in_window' ELSE '' END AS data_quality_flags, round(score, 6) AS score, fa AS funds_accumulating, ft AS funds_trimming, nf AS net_funds, cf AS conviction_funds,
  round(aw, 6) AS avg_weight_pct, round(total_value_usd, 2) AS total_value_usd, nbuy AS open_market_buyers, round(bval, 2) AS buy_value_usd,
  execution_timestamp, adjusted_entry_price, adjusted_exit_price, forward_return_20d, forward_return_60d, forward_return_120d FROM feats""",
    "v4_features_without_trades": "SELECT report_date, ticker, '13f_only_no_form4' AS feature_scope, 'insider_features_not_joined' AS data_quality_flags, quadrant, round(score, 6) AS score FROM flats",
    "p10_universe_restriction": """SELECT report_date, ticker, funds_accumulating, funds_trimming FROM inst
 WHERE ticker IN (SELECT ticker FROM prices WHERE date = (SELECT max(date) FROM prices))""",
    "k9_export_rows": """SELECT report_date, ticker, issuer_name, round(score, 6) AS score, fund_moves, 'local' AS price_source, '13f_form4_joined' AS feature_scope, '' AS market_cap,
 nbuy AS open_market_buyers, forward_return_60d FROM feats""",
    "k13_version_stamps": """SELECT 'confluence_v1' AS score_version, 'confluence_features_v1' AS feature_schema_version, 'heuristic_default_v1' AS weight_version,
 'c5bf5faef27cd75b36f16aaded40fd860024f71317373f0ccadd209acfb6084c' AS parameter_hash, 'test' AS code_commit, count(*) AS n FROM inst""",
    "a30_accession_hashes": f"""SELECT i.report_date, i.ticker, {JSON_LIST.format('i.accs')} AS filings_hash, CASE WHEN f.accs IS NULL THEN sha256('[]') ELSE {JSON_LIST.format('f.accs')} END AS trades_hash
 FROM inst i LEFT JOIN f4acc f ON f.ticker = i.ticker AND f.as_of = i.as_of""",
    "o6_accession_sets": """SELECT i.report_date, i.ticker, array_to_string(i.accs, ';') AS filings, coalesce(array_to_string(f.accs, ';'), '') AS trades
 FROM inst i LEFT JOIN f4acc f ON f.ticker = i.ticker AND f.as_of = i.as_of""",
    "j18_refresh_cached_scores": f"""SELECT c.ticker, 50.0::DOUBLE AS score, round(coalesce(i.total_value_usd, 0), 2) AS total_value_usd, coalesce(i.conviction_funds, 0) AS conviction_funds, i.ticker IS NOT NULL AS enriched
 FROM (SELECT DISTINCT {tick(BNO)} AS ticker FROM part) c LEFT JOIN last_inst i ON i.ticker = c.ticker""",
}


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
