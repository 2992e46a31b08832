"""SQL for the filing alerts: their texts and their delivery."""

from oracles.base import sql
from oracles.filings import usd
from oracles.workspace import EXTRA as WORKSPACE, SIZE


def lines(kind: str) -> str:
    return f"string_agg(text, chr(10) ORDER BY place) FILTER (move = '{kind}') AS l_{kind}"


def section(kind: str, title: str) -> str:
    return f"CASE WHEN l_{kind} IS NOT NULL THEN '{title}:' || chr(10) || l_{kind} || chr(10) END"


EXTRA = {
    **WORKSPACE,
    "newfiling": """SELECT f.cik, f.accession, f.form, f.filing_date, f.report_date, q.prev_report_date FROM filings f LEFT JOIN prevq q ON q.cik = f.cik AND q.report_date = f.report_date
 QUALIFY row_number() OVER (PARTITION BY f.cik ORDER BY f.filing_date DESC, f.accession DESC) = 1""",
    "placed": f"""SELECT m.cik, move, row_number() OVER (PARTITION BY m.cik, move ORDER BY {SIZE} DESC, cusip, put_call) AS place,
  '  - ' || coalesce(nullif(ticker, '') || ' ', '') || coalesce(issuer, '') || ': ' || CASE move WHEN 'NEW' THEN 'NEW ' || {usd('round(curr_value, 2)')} WHEN 'EXIT' THEN 'EXIT ' || {usd('round(prev_value, 2)')}
   ELSE coalesce(CASE WHEN share_change_pct < 0 THEN '-' ELSE '+' END || CAST(abs(round(round(share_change_pct, 9) * 100)) AS BIGINT) || '% shares', move) END
   || CASE WHEN put_call <> '' THEN ' [' || put_call || ']' ELSE '' END AS text
 FROM moves m JOIN newfiling n ON n.cik = m.cik AND n.report_date = m.report_date WHERE move <> 'HOLD'""",
    "sections": f"SELECT cik, {', '.join(lines(k) for k in ('NEW', 'EXIT', 'ADD', 'TRIM'))} FROM placed WHERE place <= 15 GROUP BY cik",
    "movecount": "SELECT cik, " + ", ".join(f"count(*) FILTER (move = '{k}') AS n_{k.lower()}" for k in ("NEW", "EXIT", "ADD", "TRIM")) + " FROM placed GROUP BY cik",
    "titled": """SELECT n.*, coalesce(n_new, 0) AS n_new, coalesce(n_exit, 0) AS n_exit, coalesce(n_add, 0) AS n_add, coalesce(n_trim, 0) AS n_trim,
  f.label || ' 13F' || CASE WHEN form LIKE '%/A' THEN ' (amendment)' ELSE '' END || ' (' || report_date || '): '
   || CASE WHEN coalesce(n_new, 0) + coalesce(n_exit, 0) = 0 THEN 'filing update' ELSE concat_ws(', ', CASE WHEN n_new > 0 THEN n_new || ' new' END, CASE WHEN n_exit > 0 THEN n_exit || ' exits' END) END AS subject
 FROM newfiling n JOIN funds f ON f.cik = n.cik LEFT JOIN movecount c ON c.cik = n.cik""",
}

SQL = {
    "v12_alert_messages": f"""SELECT t.cik, accession, subject, n_new, n_exit, n_add, n_trim, concat_ws(chr(10), subject, '',
  'Quarter ' || report_date || coalesce(' vs ' || prev_report_date, ' (first filing on record)') || ' | filed ' || filing_date || ' | ' || form, '',
  {section('NEW', 'New')}, {section('EXIT', 'Exited')}, {section('ADD', 'Added')}, {section('TRIM', 'Trimmed')},
  'https://www.sec.gov/Archives/edgar/data/' || CAST(t.cik AS BIGINT) || '/' || replace(accession, '-', '') || '/') AS body FROM titled t LEFT JOIN sections s ON s.cik = t.cik""",
    "st1_channel_deliveries": """SELECT subscription_id, n.accession, 'sent' AS status, CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END::BIGINT AS attempts,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'channel is down' END AS error
 FROM subs s JOIN newest n ON n.cik = s.cik JOIN customer c ON c.c_custkey = s.c_custkey WHERE active AND s.c_custkey % 3 <> 0 AND s.c_custkey % 7 <> 0""",
}


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
