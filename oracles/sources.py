"""SQL for the document, reference-file and column-function queries."""

from oracles.base import BNO, CTES, sql, tick
from oracles.filings import usd

TK = tick(BNO)
NOISE = ("INC INCORPORATED CORP CORPORATION CO COMPANY COMPANIES LTD LIMITED LLC LP PLC NV SA AG SE THE COM CL CLASS A B C "
         "HLDG HLDGS HOLDING HOLDINGS GROUP GRP TR TRUST FUND ADR ADS SPONSORED NEW").split()


def norm(x: str) -> str:
    noise = "[" + ", ".join(f"'{w}'" for w in NOISE) + "]"
    return f"array_to_string(list_filter(string_split(regexp_replace(upper({x}), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({noise}, w)), ' ')"


SHIP = "CAST(l_shipdate AS DATE)"
SORT = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus"
YR = "CAST({} + INTERVAL 26 YEAR AS DATE)"
ODD = "CAST(shares AS INT) % 4"
POS = "concat_ws('-', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_extendedprice AS VARCHAR))"
NAME = "CASE l_linenumber WHEN 1 THEN 'primary_doc.xml' WHEN 2 THEN 'cover.txt' WHEN 3 THEN 'doc-index.xml' WHEN 4 THEN 'style.xsl' ELSE 'Table' || l_partkey || '.XML' END"

EXTRA = {
    "lp": "SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey",
    "co": f"""SELECT p_name || ([' Inc.', ' Corp', ', The', ' Holdings plc', ' A/S', ''])[p_size % 6 + 1] AS title, lower({TK}) AS ticker, CAST({BNO} AS BIGINT) AS cik_str, p_partkey AS file_order FROM part""",
    "nidx": f"""SELECT {norm('title')} AS norm, ticker, title, file_order FROM co""",
    "parsed": "SELECT *, accession LIKE '%|7' AS other FROM trades",
    "lst": f"""SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SORT}) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS cnt,
  CASE l_linenumber WHEN 1 THEN '13F-HR' WHEN 2 THEN '13F-HR/A' WHEN 3 THEN '4' WHEN 4 THEN '4/A' WHEN 5 THEN '4' ELSE '10-K' END AS form,
  l_partkey || '-' || l_suppkey AS accession FROM lineitem""",
    "pkg": f"SELECT l_orderkey AS accession, {POS} AS pos, {NAME} AS name, l_linestatus = 'F' AS is4, l_returnflag <> 'N' AS holds FROM lineitem",
    "hist": f"""SELECT id AS seq, (['TA', 'TB', 'TC'])[k % 3 + 1] AS ticker, duration_ms AS score, CASE WHEN k % 2 = 0 THEN 'conviction' ELSE 'neutral' END AS quadrant,
  CASE WHEN k % 4 = 0 THEN 30 ELSE 90 END AS w, tm, k FROM ev""",
    "f4raw": """SELECT q, CASE WHEN q = 1 THEN '' WHEN q = 2 THEN 'QQQ' ELSE ticker END AS t, CASE WHEN q = 3 THEN '0000000000' WHEN q = 4 THEN '0000000077' ELSE issuer_cik END AS cik,
  CASE WHEN q = 5 THEN '' WHEN q = 6 THEN issuer_name || ' Inc' ELSE issuer_name END AS name, CASE WHEN q = 7 THEN '' ELSE accession END AS accession,
  CASE WHEN q = 8 THEN NULL ELSE filing_date END AS fd, CASE WHEN q = 9 THEN NULL ELSE transaction_date END AS td, owner_cik,
  CASE WHEN q = 10 THEN 'Z' ELSE transaction_code END AS code, CASE WHEN q = 11 THEN '' ELSE acquired_disposed END AS side,
  CASE WHEN q = 12 THEN -3 WHEN q = 13 THEN NULL ELSE shares END AS sh, CASE WHEN q = 14 THEN -1 WHEN q = 15 THEN NULL ELSE price_per_share END AS px
 FROM (SELECT *, CAST(shares AS INT) AS q FROM trades)""",
    "uni": f"SELECT DISTINCT {TK} AS ticker FROM part UNION SELECT 'ZZZ'",
    "f4prob": """SELECT *, list_filter([CASE WHEN t = '' THEN 'missing_ticker' END, CASE WHEN t <> '' AND t NOT IN (SELECT ticker FROM uni) THEN 'ticker_outside_universe' END,
  CASE WHEN cik = '0000000000' THEN 'missing_issuer_cik' END, CASE WHEN name = '' THEN 'missing_issuer_name' END, CASE WHEN accession = '' THEN 'missing_accession' END,
  CASE WHEN fd IS NULL THEN 'invalid_filing_date' END, CASE WHEN td IS NULL THEN 'invalid_transaction_date' END, CASE WHEN td < DATE '2021-02-01' THEN 'transaction_before_start' END,
  CASE WHEN td > DATE '2027-09-30' THEN 'transaction_after_end' END, CASE WHEN code = 'Z' THEN 'unexpected_transaction_code' END, CASE WHEN side = '' THEN 'unexpected_acquired_disposed' END,
  CASE WHEN sh <= 0 THEN 'non_positive_shares' END, CASE WHEN sh IS NULL THEN 'invalid_shares' END, CASE WHEN px < 0 THEN 'negative_price_per_share' END, CASE WHEN px IS NULL THEN 'invalid_price_per_share' END],
  lambda x: x IS NOT NULL) AS problems FROM f4raw""",
    "f4good": "SELECT t, cik, name, code, side, td, accession, owner_cik, sh, px, count(*) AS copies FROM f4prob WHERE len(problems) = 0 GROUP BY ALL",
    "sec": f"""SELECT no, p_type, min(p_name) AS p_name, 'BR' || lpad(CAST(no AS VARCHAR), 4, '0') || CASE p_type WHEN 'ECONOMY' THEN '100' WHEN 'LARGE' THEN '200' WHEN 'MEDIUM' THEN '300' WHEN 'PROMO' THEN '400' WHEN 'SMALL' THEN '500' ELSE '600' END AS cusip,
  {tick('CAST(no AS VARCHAR)')} AS tk FROM (SELECT *, CAST({BNO} AS INT) AS no FROM part) GROUP BY no, p_type""",
    "nidx2": f"SELECT norm, arg_min(ticker, file_order) AS ticker, arg_min(title, file_order) AS title FROM nidx WHERE title NOT LIKE 'red %' AND title NOT LIKE 'old %' AND length(norm) >= 3 GROUP BY norm",
    "cache": """SELECT cusip, CASE WHEN p_type <> 'LARGE' THEN tk END AS ticker, upper(p_name) AS name, CASE p_type WHEN 'LARGE' THEN 0.0::DOUBLE WHEN 'SMALL' THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
  no * 3 AS age FROM sec WHERE no % 5 = 0""",
    "items": "SELECT cusip, p_name || ' Corp' AS issuer, no, p_type, p_name, tk FROM sec",
}


def chain(items: str) -> str:
    """The resolution chain over a relation (cusip, issuer)."""
    return f"""SELECT i.cusip, i.issuer,
  CASE WHEN kept THEN c.ticker WHEN m.cusip IS NOT NULL THEN 'M' || m.tk WHEN f.cusip IS NOT NULL THEN f.tk ELSE NULL END AS t1,
  CASE WHEN kept THEN c.name WHEN m.cusip IS NOT NULL THEN m.p_name WHEN f.cusip IS NOT NULL THEN f.p_name || ' Inc' END AS n1,
  CASE WHEN kept THEN 'openfigi' WHEN m.cusip IS NOT NULL THEN 'manual' WHEN f.cusip IS NOT NULL THEN 'openfigi' END AS s1,
  CASE WHEN kept THEN c.confidence WHEN m.cusip IS NOT NULL THEN 1.0::DOUBLE WHEN f.cusip IS NOT NULL THEN 0.95::DOUBLE END AS c1,
  CASE WHEN kept THEN 0 WHEN m.cusip IS NOT NULL THEN 1 ELSE 2 END AS tier
 FROM {items} i LEFT JOIN (SELECT *, (ticker IS NOT NULL AND confidence >= 0.5) OR age < 30 AS kept FROM cache) c ON c.cusip = i.cusip
 LEFT JOIN (SELECT * FROM sec WHERE p_type = 'PROMO' AND no % 4 = 1) m ON m.cusip = i.cusip
 LEFT JOIN (SELECT * FROM sec WHERE p_type = 'STANDARD' AND no % 3 <> 0) f ON f.cusip = i.cusip"""


def finish(direct: str) -> str:
    return f"""SELECT d.cusip, CASE WHEN s1 IS NOT NULL THEN t1 WHEN s.p IS NOT NULL THEN s.ticker WHEN n.norm IS NOT NULL THEN n.ticker END AS ticker,
  CASE WHEN s1 IS NOT NULL THEN n1 WHEN s.p IS NOT NULL THEN s.name WHEN n.norm IS NOT NULL THEN n.title ELSE d.issuer END AS name,
  CASE WHEN s1 IS NOT NULL THEN s1 WHEN s.p IS NOT NULL THEN 'cusip_prefix' WHEN n.norm IS NOT NULL THEN 'sec_name' ELSE 'none' END AS source,
  CASE WHEN s1 IS NOT NULL THEN c1 WHEN s.p IS NOT NULL THEN CASE WHEN {norm('d.issuer')} = {norm('s.name')} THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END WHEN n.norm IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence
 FROM {direct} d LEFT JOIN (SELECT substr(cusip, 1, 6) AS p, arg_min(ticker, (tier, cusip)) AS ticker, arg_min(name, (tier, cusip)) AS name FROM (
   SELECT cusip, t1 AS ticker, n1 AS name, tier FROM {direct} WHERE t1 IS NOT NULL AND c1 >= 0.9 UNION ALL SELECT cusip, ticker, name, 3 FROM cache WHERE ticker IS NOT NULL AND confidence >= 0.9) GROUP BY 1) s ON s.p = substr(d.cusip, 1, 6)
 LEFT JOIN nidx2 n ON n.norm = {norm('d.issuer')}"""


EXTRA["direct"] = chain("items")
EXTRA["res"] = finish("direct")
EXTRA["tailx"] = "SELECT cusip, max(issuer) AS issuer FROM snap WHERE put_call = '' AND ticker IS NULL GROUP BY cusip"
EXTRA["tdirect"] = chain("tailx")
EXTRA["tres"] = finish("tdirect")
EXTRA["bres"] = """SELECT substr(cusip, 1, 6) || '100' AS cusip, arg_max(ticker, (confidence, ticker, name, source)) AS ticker, arg_max(source, (confidence, ticker, name, source)) AS source
 FROM res WHERE ticker IS NOT NULL GROUP BY 1"""
EXTRA["pref"] = "SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY cik, report_date ORDER BY (form LIKE '%/A'), filing_date DESC, accession DESC) = 1"
F4 = "CASE WHEN is_officer THEN CAST(filing_date AS VARCHAR) ELSE CAST(transaction_date AS VARCHAR) END"
IN_WINDOW = f"NOT other AND {F4} BETWEEN '2023-01-01' AND '2025-12-31' AND transaction_date BETWEEN DATE '2023-01-01' AND DATE '2025-12-31'"


def _registry() -> str:
    from tidemark.sources.registry import TRACKED_FUNDS
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {q(c.zfill(10))}, {q(l)}, {q(m)})" for i, (l, m, c) in enumerate(TRACKED_FUNDS)) + ") g(i, cik, label, manager)"


SQL = {
    "s1_info_table_xml": """SELECT p_name AS issuer, p_type AS title_of_class, upper(p_brand) AS cusip, CASE WHEN l_linenumber % 2 = 1 THEN 'PRN' ELSE 'SH' END AS sh_prn_type,
  CASE WHEN l_returnflag = 'R' THEN 'Put' ELSE '' END AS put_call, count(*) AS n, round(sum(l_extendedprice), 2) AS value, sum(l_quantity) AS shares FROM lp GROUP BY ALL
 UNION ALL SELECT 'Spare', '', '', 'SH', '', count(*), 0.0::DOUBLE, 0.0::DOUBLE FROM lp""",
    "s2_quarantined_documents": "SELECT CASE l_linenumber WHEN 1 THEN 'dtd_or_entity' WHEN 2 THEN 'malformed' ELSE 'empty' END AS reject, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL",
    "s3_form4_xml": f"""SELECT ticker AS issuer_ticker, CASE WHEN other THEN '0000000999' ELSE issuer_cik END AS issuer_cik, transaction_code, acquired_disposed, officer_title, is_officer, is_director, is_ten_percent_owner,
  NOT is_director AS direct, count(*) AS n, sum(shares) AS shares, round(sum(price_per_share), 2) AS prices, round(sum(shares_owned_after), 2) AS owned, min({F4}) AS first_filed, max(CAST(transaction_date AS VARCHAR)) AS last_traded
 FROM parsed GROUP BY ALL""",
    "s4_malformed_skipped": "SELECT l_returnflag, count(*) * 2 AS n, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_linenumber > 4 GROUP BY ALL",
    "k8_form4_rows": f"SELECT ticker, transaction_code, count(*) AS n, round(sum(round(shares * price_per_share, 2)), 2) AS value_usd FROM parsed WHERE {IN_WINDOW} GROUP BY ALL",
    "k8_form4_summary": f"""SELECT (SELECT count(DISTINCT ticker) + 1 FROM trades) AS tickers_requested, 1::BIGINT AS tickers_without_cik, 0::BIGINT AS tickers_without_filings,
  (SELECT count(*) FROM (SELECT DISTINCT ticker, accession, issuer_name, owner_cik FROM parsed WHERE other)) AS issuer_mismatch_filings, (SELECT count(*) FROM parsed WHERE {IN_WINDOW}) AS rows_new""",
    "p13_issuer_guard": "SELECT ticker, issuer_cik AS expected_issuer_cik, '0000000999' AS actual_issuer_cik, count(DISTINCT (accession, owner_cik)) AS n FROM parsed WHERE other GROUP BY ALL",
    "j11_ticker_cik_misses": "SELECT 'QQQ' AS ticker",
    "s5_filing_index": f"""SELECT l_orderkey AS owner, form, accession, CAST({SHIP} AS VARCHAR) AS filing_date, CAST(last_day(l_shipdate) AS VARCHAR) AS report_date,
  CASE WHEN pos = cnt THEN '' ELSE 'd' || CAST(l_quantity AS INT) END AS primary_doc FROM lst WHERE form LIKE '13F-HR%'""",
    "s5_originals_only": f"SELECT form, count(*) AS n, max(CAST({SHIP} AS VARCHAR)) AS newest FROM lst WHERE form = '13F-HR' GROUP BY ALL",
    "s6_form4_index": f"""SELECT l_orderkey AS owner, form, accession, CAST({SHIP} AS VARCHAR) AS filing_date FROM lst WHERE form IN ('4', '4/A') AND l_shipdate >= DATE '1997-01-01'
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) <= 2""",
    "s7_pick_info_table": """SELECT accession, CASE WHEN bool_and(name = 'primary_doc.xml') THEN arg_min(name, pos) FILTER (holds) ELSE arg_min(name, pos) FILTER (holds AND name <> 'primary_doc.xml') END AS name
 FROM pkg WHERE lower(name) LIKE '%.xml' GROUP BY accession HAVING name IS NOT NULL""".replace("HAVING name", "HAVING CASE WHEN bool_and(name = 'primary_doc.xml') THEN arg_min(name, pos) FILTER (holds) ELSE arg_min(name, pos) FILTER (holds AND name <> 'primary_doc.xml') END"),
    "s8_pick_ownership": "SELECT accession, arg_min(name, (CASE WHEN is4 THEN 0 ELSE 1 END, pos)) AS name FROM pkg WHERE lower(name) LIKE '%.xml' AND name <> 'doc-index.xml' GROUP BY accession",
    "s9_name_index": "SELECT norm, arg_min(ticker, file_order) AS ticker, arg_min(title, file_order) AS title FROM nidx WHERE length(norm) >= 3 GROUP BY norm",
    "s10_ticker_cik_map": "SELECT upper(ticker) AS ticker, lpad(CAST(arg_min(cik_str, file_order) AS VARCHAR), 10, '0') AS cik FROM co GROUP BY 1",
    "s11_select_instrument": f"""SELECT cusip, 'C' || p_partkey AS ticker, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN 'BBG' ELSE 'F' END || p_partkey AS figi,
  CASE WHEN p_size % 2 = 0 THEN 'Common Stock' ELSE 'REIT' END AS security_type, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Equity' ELSE 'Corp' END AS market_sector FROM (
  SELECT *, 'BR' || lpad({BNO}, 4, '0') || lpad(CAST(p_partkey % 40 AS VARCHAR), 3, '0') AS cusip FROM part)
 QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY p_size % 3 = 0, p_type NOT IN ('SMALL', 'LARGE'), p_size % 2 <> 0, p_partkey) = 1""",
    "s12_price_csv": f"SELECT 'O' || l_orderkey AS ticker, {SHIP} AS date, l_extendedprice AS adj_close FROM lineitem WHERE l_orderkey % 10 <> 9 AND l_linenumber NOT IN (6, 7)",
    "s13_chart_json": f"SELECT 'O' || l_orderkey AS ticker, {SHIP} AS date, l_extendedprice + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS adj_close FROM lineitem WHERE l_linenumber <> 7",
    "s14_aggregates_json": f"SELECT 'O' || l_orderkey AS ticker, {SHIP} AS date, l_extendedprice AS adj_close FROM lineitem WHERE l_linenumber <> 7",
    "s15_fundamentals_json": "SELECT 'P' || p_partkey AS ticker, p_retailprice AS market_cap, CASE WHEN p_size % 3 = 1 THEN p_size::DOUBLE ELSE p_size * 2.0::DOUBLE END AS shares_outstanding FROM part WHERE p_size <> 7",
    "s16_adjusted_price_file": f"""SELECT {TK} AS ticker, {YR.format('l_shipdate')} AS date, count(*) AS n, round(sum(CASE WHEN l_linenumber = 4 THEN 2.5 ELSE l_extendedprice END), 2) AS adj_close
 FROM lp WHERE l_linenumber NOT IN (1, 3) GROUP BY ALL""",
    "s17_form4_aliases": f"""SELECT ticker, issuer_cik, CASE WHEN {ODD} = 0 THEN 'P' ELSE transaction_code END AS transaction_code,
  CASE WHEN {ODD} = 1 THEN acquired_disposed WHEN {ODD} = 0 OR transaction_code = 'P' THEN 'A' WHEN transaction_code = 'S' THEN 'D' ELSE '' END AS acquired_disposed, is_officer, NOT is_director AS direct,
  count(*) AS n, round(sum(round(shares * price_per_share, 2)), 2) AS value, max(CASE WHEN {ODD} = 2 THEN filing_date ELSE transaction_date END) AS last_filed
 FROM trades GROUP BY ALL""",
    "s18_ticker_list": f"SELECT DISTINCT {TK} AS ticker FROM part WHERE p_size % 10 NOT IN (0, 1)",
    "s20_read_signal_history": "SELECT seq, ticker, CAST(w AS BIGINT) AS window_days, score, quadrant FROM hist WHERE k <> 50 AND ticker = 'TB' AND w = 90 ORDER BY seq DESC",
    "s21_fund_registry": f"SELECT g.cik, g.label, g.manager, count(*) AS filings FROM resolved r JOIN {_registry()} ON CAST(r.cik AS BIGINT) % 46 = g.i GROUP BY ALL",
    "k10_signal_history": """SELECT strftime(tm, '%Y-%m-%d %H:%M:%S') AS recorded_at, CAST(w AS BIGINT) AS window_days, ticker, round(score, 1) AS score, quadrant,
  sha256('{"quadrant":"' || quadrant || '","score":"' || CAST(round(score, 1) AS VARCHAR) || '","ticker":"' || lower(ticker) || '","version":"confluence_v1","window_days":"' || w || '"}') AS revision_hash FROM hist""",
    "f1_normalize_name": f"SELECT file_order, {norm(chr(39) + 'The ' + chr(39) + ' || title || ' + chr(39) + ' & Co. Class A' + chr(39))} AS norm FROM co",
    "f2_clean_ids": """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS clean, NULL::VARCHAR AS bad_cik,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) <= 8 THEN 'BRK.' || c_custkey END AS ticker, NULL::VARCHAR AS bad_ticker FROM customer""",
    "f12_f14_dates_and_splits": f"""SELECT o_orderkey, d, CASE WHEN d IS NULL THEN 'invalid' WHEN d BETWEEN DATE '2014-01-01' AND DATE '2022-12-31' THEN 'train' WHEN d BETWEEN DATE '2023-01-01' AND DATE '2024-12-31' THEN 'validation'
  WHEN d BETWEEN DATE '2025-01-01' AND DATE '2026-12-31' THEN 'test' ELSE 'outside' END AS split FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN {YR.format('o_orderdate')} END AS d FROM orders)""",
    "f13_lenient_numbers": """SELECT l_linenumber, count(*) FILTER (l_linenumber IN (1, 5, 7)) AS finite, count(*) FILTER (l_linenumber IN (1, 6, 7)) AS positive, count(*) AS with_commas,
  round(sum(CASE WHEN l_linenumber IN (1, 7) THEN l_extendedprice WHEN l_linenumber = 5 THEN -l_extendedprice END), 2) AS total, count(*) FILTER (l_linenumber <= 4) AS true_flags FROM lineitem GROUP BY ALL""",
    "f15_lists": "SELECT p_partkey, 3::BIGINT AS n, 'a;' || p_name || ';' || p_type AS joined FROM part",
    "f16_time_buckets": "SELECT 'm:' || strftime(tm, '%Y%m%d%H%M') AS minute, 'd:' || strftime(tm, '%Y%m%d') AS day, count(*) AS n FROM ev GROUP BY ALL",
    "f18_provider_symbols": f"""SELECT p_partkey, {TK} || CASE p_size % 3 WHEN 0 THEN '.B' WHEN 1 THEN '.A' ELSE '' END AS massive, {TK} || CASE p_size % 3 WHEN 0 THEN '-B' WHEN 1 THEN '-A' ELSE '' END AS yahoo,
  lower({TK}) || CASE p_size % 3 WHEN 0 THEN '-b' WHEN 1 THEN '-a' ELSE '' END || '.us' AS stooq FROM part""",
    "f19_usd_text": f"""SELECT accession, {usd('round(total_value, 2)')} AS usd, 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS BIGINT) || '/' || replace(accession, '-', '') || '/' AS url FROM resolved""",
    "f21_client_family": """SELECT client, CASE client WHEN 'codex-cli' THEN 'Codex' WHEN 'ChatGPT' THEN 'ChatGPT' WHEN 'cursor 1.2' THEN 'Cursor' WHEN 'VS Code; vscode' THEN 'VS Code'
  WHEN 'my cline bot' THEN 'Cline' WHEN 'mcp-inspector' THEN 'MCP Inspector' ELSE 'Other MCP clients' END AS family, count(*) AS n FROM telemetry GROUP BY ALL""",
    "f22_list_hash": """SELECT l_suppkey, sha256('["' || string_agg(DISTINCT p_brand, '","' ORDER BY p_brand) || '"]') AS hash FROM lp GROUP BY ALL""",
    "f23_counter_sanitizing": """SELECT id, CAST(greatest(floor(duration_ms) - 20, 0) AS BIGINT) AS count, CAST(CASE WHEN duration_ms = floor(duration_ms) THEN duration_ms ELSE 0 END AS BIGINT) AS from_text,
  CAST(CASE WHEN duration_ms * 300 - 1000 < 0 THEN 0 ELSE least(round(duration_ms * 300 - 1000), 60000) END AS BIGINT) AS duration FROM ev""",
    "f27_row_key": """SELECT ticker, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT ticker, accession, owner_cik, transaction_date, transaction_code, acquired_disposed, shares, price_per_share, count(*) AS n FROM trades GROUP BY ALL) GROUP BY ALL""",
    "k7_merge_form4": """SELECT ticker, transaction_code, count(*) AS n, count(*) FILTER (transaction_code = 'P') AS restated FROM (
  SELECT DISTINCT ticker, accession, owner_cik, transaction_date, transaction_code, acquired_disposed, shares, price_per_share FROM trades) GROUP BY ALL""",
    "p9_ticker_flags": f"""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'missing_ticker' ELSE concat_ws(';', CASE WHEN p_size % 6 = 1 THEN 'currency_suffixed_ticker' END, CASE WHEN p_size % 5 = 0 THEN 'non_common_equity_title' END,
  CASE WHEN p_size % 6 IN (1, 3) THEN 'non_priceable_ticker' END) END AS flags FROM part""",
    "a17_form4_validation": """, k AS (SELECT *, sum(copies) OVER (PARTITION BY t, accession, owner_cik, td, code, side, sh, px) AS c FROM f4good
   QUALIFY row_number() OVER (PARTITION BY t, accession, owner_cik, td, code, side, sh, px ORDER BY cik, name) = 1),
 iss AS (SELECT t, count(DISTINCT cik) AS c, count(DISTINCT name) AS n FROM k GROUP BY t)
 SELECT *, CASE WHEN invalid_rows + duplicate_rows + mixed_issuer_tickers + unexpected_tickers > 0 OR rows_valid = 0 THEN 'review' ELSE 'ready' END AS status FROM (SELECT
  (SELECT count(*) FROM f4raw) AS rows_total, (SELECT count(*) FROM f4prob WHERE len(problems) > 0) AS invalid_rows,
  (SELECT count(DISTINCT t) FROM f4prob WHERE list_contains(problems, 'ticker_outside_universe')) AS unexpected_tickers, (SELECT count(*) FROM k) AS rows_valid, (SELECT CAST(sum(c - 1) AS BIGINT) FROM k) AS duplicate_rows,
  (SELECT count(DISTINCT t) FROM k) AS tickers_observed, (SELECT count(*) FROM k WHERE code = 'P' AND side = 'A') AS open_market_buy_rows, (SELECT count(DISTINCT t) FROM k WHERE code = 'P' AND side = 'A') AS open_market_buy_tickers,
  (SELECT count(*) FROM k WHERE code = 'S' AND side = 'D') AS open_market_sell_rows, (SELECT count(DISTINCT t) FROM k WHERE code = 'S' AND side = 'D') AS open_market_sell_tickers,
  (SELECT min(td) FROM k) AS earliest_transaction_date, (SELECT max(td) FROM k) AS latest_transaction_date, (SELECT count(*) FROM iss WHERE c > 1) AS mixed_issuer_tickers, (SELECT count(*) FROM iss WHERE c = 1 AND n > 1) AS issuer_name_variants,
  (SELECT count(*) FROM uni) AS ticker_universe_count, (SELECT count(*) FROM uni WHERE ticker NOT IN (SELECT t FROM k)) AS tickers_empty)""",
    "a17_form4_problems": "SELECT unnest(problems) AS problem, count(*) AS n FROM f4prob GROUP BY 1",
    "a17_form4_code_counts": """SELECT code, side, count(*) AS n FROM (SELECT DISTINCT t, accession, owner_cik, td, code, side, sh, px FROM f4prob
  WHERE len(list_filter(problems, lambda x: x NOT IN ('ticker_outside_universe', 'transaction_before_start', 'transaction_after_end'))) = 0) GROUP BY ALL""",
    "o3_missing_and_unexpected": "SELECT ticker, 'missing' AS side FROM uni WHERE ticker NOT IN (SELECT t FROM f4raw) UNION ALL SELECT DISTINCT t, 'unexpected' FROM f4raw WHERE t <> '' AND t NOT IN (SELECT ticker FROM uni)",
    "j6_resolution_chain": "SELECT cusip, ticker, name, source, confidence FROM res",
    "j7_j8_prefix_and_name_hits": "SELECT source, confidence, count(*) AS n FROM res GROUP BY ALL",
    "k3_apply_resolutions": """SELECT p.cusip, coalesce(p.ticker, b.ticker) AS ticker, CASE WHEN p.ticker IS NULL THEN b.source END AS ticker_source, p.ticker IS NULL AND b.ticker IS NOT NULL AS backfilled, count(*) AS n,
  count(*) FILTER (put_call = '' OR (p.ticker IS NULL AND b.ticker IS NOT NULL)) AS named FROM positions p LEFT JOIN bres b ON b.cusip = p.cusip GROUP BY ALL""",
    "k4_resolve_sweep": "SELECT source, count(*) AS n, count(ticker) AS applied FROM tres GROUP BY ALL",
    "j20_enrich_positions": """SELECT put_call, CASE WHEN put_call = '' THEN b.ticker END AS ticker, CASE WHEN put_call = '' THEN b.source END AS ticker_source, count(*) AS n, sum(shares) AS shares
 FROM positions p LEFT JOIN bres b ON b.cusip = p.cusip GROUP BY ALL""",
    "a5_coverage_by_source": """SELECT accession, b.source AS ticker_source, count(*) AS n_resolved, round(sum(value_usd), 2) AS value_resolved FROM positions p JOIN bres b ON b.cusip = p.cusip WHERE put_call = '' GROUP BY ALL""",
    "l4_worst_unresolved": """SELECT accession, row_number() OVER w AS tail_rank, cusip, round(value_usd, 2) AS value_usd FROM positions WHERE put_call = '' AND ticker IS NULL
 WINDOW w AS (PARTITION BY accession ORDER BY round(value_usd, 2) DESC, cusip) QUALIFY row_number() OVER w <= 3""",
    "u6_manual_overrides": "SELECT cusip, 'M' || tk AS ticker, 1.0::DOUBLE AS confidence FROM sec WHERE p_type = 'PROMO' AND no % 4 = 1",
    "k1_replace_filings": "SELECT report_date, count(*) AS n, sum(shares * CASE WHEN report_date = (SELECT max(report_date) FROM positions) THEN 2 ELSE 1 END) AS shares FROM positions GROUP BY ALL",
    "k1_partition_overwrite": "SELECT report_date, count(*) AS n, sum(shares * CASE WHEN report_date = (SELECT max(report_date) FROM positions) THEN 2 ELSE 1 END) AS shares FROM positions GROUP BY ALL",
    "k2_upsert_funds": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE upper(s_name) END AS label,
  CASE WHEN s_suppkey % 3 = 1 THEN 'old' WHEN s_suppkey % 2 = 0 THEN 'new' WHEN s_suppkey % 3 = 2 THEN 'old' END AS manager FROM supplier""",
    "k5_incremental_sync": "SELECT 'forced' AS run, form, count(*) AS n FROM pref GROUP BY ALL UNION ALL SELECT 'new', form, count(*) FROM pref WHERE report_date >= DATE '2026-01-01' GROUP BY ALL",
    "p6_stored_accessions": "SELECT f.cik, r.accession IS NOT NULL AS stored, count(*) AS n FROM filings f LEFT JOIN resolved r ON r.accession = f.accession GROUP BY ALL",
    "o1_union_with_override": "SELECT cik, label FROM f_funds",
}


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
