"""SQL for the rank-statistic and evidence queries."""

import math

from oracles.base import sql
from oracles.scores import D0, EXTRA as SCORES, SPLIT, sat, scored

DRAW = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', split, baseline, CAST(rep AS VARCHAR), CAST(pos AS VARCHAR))), 1, 13) AS BIGINT)"
SETS = {
    "default": {}, "funds": {"36.0::DOUBLE * (CASE WHEN cu": "10.0::DOUBLE * (CASE WHEN cu", "18.0::DOUBLE * log10": "0.0::DOUBLE * log10", "(25000001.0::DOUBLE), 18.0::DOUBLE)": "(25000001.0::DOUBLE), 0.0::DOUBLE)"},
    "insiders": {"36.0::DOUBLE * (CASE WHEN (fa": "10.0::DOUBLE * (CASE WHEN (fa", "18.0::DOUBLE * (0.5 +": "0.0::DOUBLE * (0.5 +"},
}


def variant(name: str) -> str:
    text = scored("feat_in")
    for old, new in SETS[name].items():
        assert old in text, old
        text = text.replace(old, new)
    return f"SELECT '{name}' AS weight_set, as_of, ticker, score, forward_return_60d AS ret FROM ({text}) WHERE forward_return_60d IS NOT NULL"


def stats(source: str, g: str) -> str:
    """Metrics of a relation (g, score, ret, as_of, ticker)."""
    return f"""SELECT {g}, n, coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0) AS rank_ic,
  CASE WHEN n >= 5 THEN avg(ret) FILTER (pos > n - size) - avg(ret) FILTER (pos <= size) ELSE 0 END AS spread,
  CASE WHEN n >= 5 THEN avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (pos > n - size) ELSE 0 END AS hit, avg(ret) AS mean_ret
 FROM (SELECT *, greatest(1, n // 5) AS size FROM (SELECT *, count(*) OVER (PARTITION BY {g}) AS n, row_number() OVER (PARTITION BY {g} ORDER BY score, as_of, ticker) AS pos,
  rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY {g} ORDER BY ret) + (count(*) OVER (PARTITION BY {g}, ret) - 1) / 2 AS ry FROM {source})) GROUP BY {g}, n"""


WEIGHTS = {"institutional_breadth": (36, 10, 50), "insider_cluster": (36, 10, 50), "dollar_conviction": (18, 0, 35),
           "agreement_bonus": (18, 0, 35), "institutional_trim_penalty": (14, 0, 30), "insider_sell_penalty": (14, 0, 30)}
W = [f"w{i}" for i in range(len(WEIGHTS))]


def sweep_ctes() -> dict[str, str]:
    """Four passes of the weight sweep, one after the other."""
    out = {
        "sided": """SELECT *, coalesce(funds_accumulating, 0) AS fa, coalesce(funds_trimming, 0) AS ft, coalesce(conviction_funds, 0) AS cf, coalesce(avg_weight_pct, 0) AS aw,
  coalesce(n_buyers, 0) AS nbuy, coalesce(n_sellers, 0) AS nsell, coalesce(buy_value_usd, 0) AS bval, coalesce(sell_value_usd, 0) AS sval,
  coalesce(conviction_units, 0) AS cu, coalesce(recency_weighted_buy_usd, 0) AS rw, coalesce(days_since_last_buy, 999) AS dl, coalesce(recent_cluster_n, 0) AS rc FROM feat_in WHERE forward_return_60d IS NOT NULL""",
        "unitp": f"""SELECT as_of, ticker, forward_return_60d AS ret, {sat('(fa * (1 + 0.5 * ' + sat('cf', '2') + ' + 0.5 * least(1.0::DOUBLE, aw / 5)))', '1.5')} AS u0, {sat('cu', '1.2')} AS u1,
  CASE WHEN rw > 0 THEN least(log10(rw + 1) / log10(25000001.0::DOUBLE), 1.0::DOUBLE) ELSE {D0} END AS u2,
  CASE WHEN fa > 0 AND nbuy > 0 THEN 0.5 + 0.5 * greatest(CASE WHEN dl <= 0 THEN 1 ELSE pow(0.5, dl / 30.0::DOUBLE) END, {sat('rc', '1')}) ELSE {D0} END AS u3,
  -(CASE WHEN ft > fa THEN {sat('ft', '3')} ELSE {D0} END) AS u4, -(CASE WHEN sval > bval AND sval > 0 THEN {sat('nsell', '2')} ELSE {D0} END) AS u5 FROM sided""",
        "best0": "SELECT " + ", ".join(f"{v[0]}::DOUBLE AS w{i}" for i, v in enumerate(WEIGHTS.values())),
    }
    for k, step in enumerate((8, 4, 2, 1), 1):
        bounds = list(WEIGHTS.values())
        moved = lambda i, by: f"least({bounds[i][2]}::DOUBLE, greatest({bounds[i][1]}::DOUBLE, w{i} + {by}))"
        tried = [", ".join(W)] + [", ".join(moved(i, by) if i == j else w for j, w in enumerate(W)) for i in range(len(W)) for by in (step, -step)]
        out[f"cand{k}"] = " UNION ALL ".join(f"SELECT {p} AS place, {', '.join(f'{x} AS {w}' for x, w in zip(t.split(', ') if p == 0 else split_top(t), W))} FROM best{k - 1}" for p, t in enumerate(tried))
        out[f"swept{k}"] = f"SELECT place, as_of, ticker, ret, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, {' + '.join(f'w{i} * u{i}' for i in range(len(W)))})), 6) AS score FROM unitp, cand{k}"
        out[f"sjudge{k}"] = f"SELECT place, round(rank_ic + 0.5 * spread, 9) AS objective FROM ({stats(f'swept{k}', 'place')})"
        out[f"best{k}"] = f"SELECT {', '.join(W)}, objective FROM sjudge{k} JOIN cand{k} USING (place) ORDER BY objective DESC, place LIMIT 1"
    return out


def split_top(text: str) -> list[str]:
    """Parts of a list between commas that no bracket holds."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


STEPS = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (2**31 - 1)) for k in range(9)]
EXTRA = {
    **SCORES,
    "ft": f"SELECT *, {SPLIT} AS split FROM feats",
    "obs": """SELECT split, baseline, as_of, ticker, score, ret FROM (
  SELECT split, as_of, ticker, forward_return_60d AS ret, unnest([{'b': 'full_score', 's': round(score, 6)}, {'b': 'insider_only', 's': round(insider_score, 6)},
   {'b': 'institutional_only', 's': round(institutional_score, 6)}, {'b': 'fund_count_only', 's': CAST(fa AS DOUBLE)},
   {'b': 'quadrant_only', 's': CASE quadrant WHEN 'conviction' THEN 4.0::DOUBLE WHEN 'divergent' THEN 1.0::DOUBLE WHEN 'distribution' THEN 0.0::DOUBLE END}]) AS e
  FROM ft WHERE forward_return_60d IS NOT NULL AND split <> 'outside'), LATERAL (SELECT e.b AS baseline, e.s AS score) WHERE score IS NOT NULL""",
    "stat": stats("obs", "split, baseline"),
    "rowsn": """SELECT *, row_number() OVER (PARTITION BY split, baseline ORDER BY as_of, ticker) - 1 AS pos, count(*) OVER (PARTITION BY split, baseline) AS total,
  rank() OVER (PARTITION BY split, baseline ORDER BY score) + (count(*) OVER (PARTITION BY split, baseline, score) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY split, baseline ORDER BY ret) + (count(*) OVER (PARTITION BY split, baseline, ret) - 1) / 2 AS ry FROM obs""",
    "drawn": f"""SELECT split, baseline, rep, {DRAW.format(seed=13)} % total AS pos FROM (SELECT * FROM rowsn WHERE total >= 8), range(250) r(rep)""",
    "boot": """SELECT d.split, d.baseline, d.rep, r.score, r.ret, LPAD(CAST(r.pos AS VARCHAR), 12, '0') AS as_of, '' AS ticker
 FROM drawn d JOIN rowsn r ON r.split = d.split AND r.baseline = d.baseline AND r.pos = d.pos""",
    "bstat": stats("boot", "split, baseline, rep"),
    "shuf": f"""SELECT split, baseline, rep, rx, row_number() OVER (PARTITION BY split, baseline, rep ORDER BY {DRAW.format(seed=17)}, pos) - 1 AS tgt
 FROM (SELECT * FROM rowsn WHERE total >= 8), range(500) r(rep)""",
    "perm": """SELECT s.split, s.baseline, rep, sum((s.rx - (total + 1) / 2) * (r.ry - (total + 1) / 2)) AS xy
 FROM shuf s JOIN rowsn r ON r.split = s.split AND r.baseline = s.baseline AND r.pos = s.tgt GROUP BY ALL""",
    "seen": "SELECT split, baseline, sum((rx - (total + 1) / 2) * (ry - (total + 1) / 2)) AS xy FROM rowsn GROUP BY ALL",
    "facs": """SELECT r, 1 + CAST('0x' || substr(md5('a|13|' || r), 1, 7) AS BIGINT) AS a, CAST('0x' || substr(md5('b|13|' || r), 1, 7) AS BIGINT) AS b FROM range(250) t(r)""",
    "numd": "SELECT *, CAST('0x' || substr(md5(concat_ws('|', split, baseline, CAST(as_of AS VARCHAR), ticker)), 1, 8) AS BIGINT) % 2147483647 AS x FROM obs",
    "wrows": f"""SELECT split, baseline, r, score, ret, len(list_filter({STEPS}, lambda s: s <= (a * x + b) % 2147483647)) AS w FROM numd, facs UNION ALL SELECT split, baseline, -1, score, ret, 1 FROM obs""",
    "repv": """SELECT split, baseline, r, CASE WHEN vv > 1e-12 THEN (xy * w - x * y) / sqrt(vv) END AS v FROM (SELECT *, (xx * w - x * x) * (yy * w - y * y) AS vv FROM (
   SELECT split, baseline, r, sum(w)::DOUBLE AS w, sum(w * score) AS x, sum(w * ret) AS y, sum(w * score * score) AS xx, sum(w * ret * ret) AS yy, sum(w * score * ret) AS xy FROM wrows GROUP BY ALL))""",
    **sweep_ctes(),
    "wobs": " UNION ALL ".join(variant(n) for n in SETS),
    "wstat": stats("wobs", "weight_set"),
    "rowx": "SELECT f.* EXCLUDE (accs), a.accs FROM ft f LEFT JOIN f4acc a ON a.ticker = f.ticker AND a.as_of = f.as_of",
    "ev1": """SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_count, count(*) AS joined_rows, count(*) FILTER (accs IS NOT NULL) AS rows_with_form4_accessions,
  count(DISTINCT ticker) FILTER (accs IS NOT NULL) AS tickers_with_form4_accessions, count(*) FILTER (nbuy > 0) AS rows_with_open_market_buyers,
  count(DISTINCT ticker) FILTER (nbuy > 0) AS tickers_with_open_market_buyers, round(sum(round(bval, 2)), 2) AS open_market_buy_value_usd,
  count(forward_return_20d) AS forward_return_20d_rows, count(forward_return_60d) AS forward_return_60d_rows, count(forward_return_120d) AS forward_return_120d_rows,
  round(count(forward_return_20d) / count(*), 6) AS forward_return_20d_coverage, round(count(forward_return_60d) / count(*), 6) AS forward_return_60d_coverage,
  round(count(forward_return_120d) / count(*), 6) AS forward_return_120d_coverage FROM rowx""",
}
ERR = "(SELECT count(*) - count(forward_return_20d) + count(*) - count(forward_return_60d) + count(*) - count(forward_return_120d) FROM rowx)"

SQL = {
    "b8_weight_sweep": " UNION ALL ".join(
        f"SELECT '{name}' AS weight, w{i} AS value, round((SELECT objective FROM sjudge1 WHERE place = 0), 6) AS objective_before, round(objective, 6) AS objective_after FROM best4"
        for i, name in enumerate(WEIGHTS)),
    "u5_resampled_correlation": """SELECT split, baseline, round(max(v) FILTER (r = -1), 6) AS value, round(l[CAST(floor(0.025 * (len(l) - 1)) AS INT) + 1], 6) AS lo, round(l[CAST(floor(0.975 * (len(l) - 1)) AS INT) + 1], 6) AS hi
 FROM repv JOIN (SELECT split, baseline, list(v ORDER BY v) FILTER (v IS NOT NULL AND r >= 0) AS l FROM repv GROUP BY ALL) USING (split, baseline) GROUP BY split, baseline, l""",
    "w12_average_ranks": """SELECT l_returnflag, l_linestatus, l_extendedprice, count(*) AS n, any_value(r) + (count(*) - 1) / 2 AS rank FROM (
  SELECT *, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY ALL""",
    "w13_top_bottom_buckets": """SELECT split, baseline, CASE WHEN pos < greatest(1, n // 5) THEN 'bottom' ELSE 'top' END AS side, as_of, ticker, pos AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY split, baseline ORDER BY score, as_of, ticker) - 1 AS pos, count(*) OVER (PARTITION BY split, baseline) AS n FROM obs)
 WHERE pos < greatest(1, n // 5) OR pos >= n - greatest(1, n // 5)""",
    "b1_rank_ic": "SELECT split, baseline, round(rank_ic, 9) AS rank_ic FROM stat",
    "b2_b3_spread_and_hit_rate": "SELECT split, baseline, n, round(spread, 6) AS top_bottom_spread, round(hit, 6) AS hit_rate FROM stat",
    "b4_metrics_by_split": "SELECT split, baseline, n, round(rank_ic, 6) AS rank_ic, round(spread, 6) AS top_bottom_spread, round(hit, 6) AS hit_rate, round(mean_ret, 6) AS mean_forward_return FROM stat",
    "b5_bootstrap_ci": """SELECT split, baseline, coalesce(ic_lo, 0) AS ic_lo, coalesce(ic_hi, 0) AS ic_hi, coalesce(sp_lo, 0) AS spread_lo, coalesce(sp_hi, 0) AS spread_hi
 FROM (SELECT DISTINCT split, baseline FROM obs) g LEFT JOIN (SELECT split, baseline, round(list_sort(list(rank_ic))[7], 6) AS ic_lo, round(list_sort(list(rank_ic))[243], 6) AS ic_hi,
  round(list_sort(list(spread))[7], 6) AS sp_lo, round(list_sort(list(spread))[243], 6) AS sp_hi FROM bstat GROUP BY ALL) USING (split, baseline)""",
    "b6_permutation_p": """SELECT split, baseline, coalesce(p, 1) AS rank_ic_permutation_p FROM (SELECT DISTINCT split, baseline FROM obs) LEFT JOIN (
  SELECT p.split, p.baseline, round((count(*) FILTER (abs(p.xy) >= abs(s.xy)) + 1) / 501, 6) AS p FROM perm p JOIN seen s ON s.split = p.split AND s.baseline = p.baseline GROUP BY ALL) USING (split, baseline)""",
    "b7_weight_sets": """SELECT weight_set, n, round(rank_ic, 5) AS ic, round(spread, 5) AS quantile_spread, round(hit, 5) AS hit_rate, round(rank_ic + 0.5 * spread, 5) AS objective FROM wstat""",
    "s19_feature_rows_csv": """SELECT CAST(report_date AS VARCHAR) AS report_date, ticker, quadrant, CASE WHEN n_visible IS NULL THEN 'no_form4_activity_in_window' ELSE '' END AS flags, round(score, 6) AS score FROM feats""",
    "s19_feature_rows_jsonl": "SELECT CAST(report_date AS VARCHAR) AS report_date, ticker, fund_moves, forward_return_20d FROM feats",
    "a13_evidence": "SELECT * FROM ev1",
    "a13_evidence_counts": """SELECT 'feature_scope' AS section, '13f_form4_joined' AS key, count(*) AS n FROM rowx UNION ALL SELECT 'split', split, count(*) FROM rowx GROUP BY ALL
 UNION ALL SELECT 'data_quality_flag', 'no_form4_activity_in_window', count(*) FROM rowx WHERE accs IS NULL HAVING count(*) > 0""",
    "a14_manifest": f"""SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_count, min(as_of) AS date_from, max(as_of) AS date_to, {ERR} AS row_error_count,
  0::BIGINT AS version_mismatch_count, '' AS missing_required_columns, '' AS missing_recommended_columns, CASE WHEN {ERR} > 0 THEN 'not_publishable' ELSE 'valid_minimum_schema' END AS status FROM rowx""",
    "a14_row_errors": """SELECT 'score' AS field, 'not_numeric' AS error, count(*) AS n FROM rowx WHERE quadrant = 'divergent' HAVING count(*) > 0
 UNION ALL SELECT 'weight_version', 'version:other', count(*) FROM rowx WHERE quadrant = 'conviction' HAVING count(*) > 0
 UNION ALL SELECT 'forward_return_20d', 'missing_value', count(*) FROM rowx WHERE forward_return_20d IS NULL HAVING count(*) > 0
 UNION ALL SELECT 'forward_return_60d', 'missing_value', count(*) FROM rowx WHERE forward_return_60d IS NULL HAVING count(*) > 0
 UNION ALL SELECT 'forward_return_120d', 'missing_value', count(*) FROM rowx WHERE forward_return_120d IS NULL HAVING count(*) > 0""",
    "a31_content_hash": """SELECT count(*) AS rows, coalesce(bit_xor(h), 0) AS xor_hash, CAST(coalesce(sum(h % 1000003), 0) AS BIGINT) AS sum_hash
 FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', l_linenumber, l_linestatus, l_orderkey, l_partkey, l_returnflag, l_suppkey)), 1, 13) AS BIGINT) AS h FROM lineitem)""",
    "a32_evidence_review": f"""SELECT CASE WHEN b <> '' THEN 'blocked' WHEN w <> '' THEN 'smoke_passed_needs_larger_sample' ELSE 'mechanical_evidence_ready_for_review' END AS status, b AS blockers, w AS warnings FROM (
 SELECT concat_ws(';', CASE WHEN {ERR} > 0 THEN 'minimum_schema_not_valid' END, CASE WHEN rows_with_form4_accessions = 0 THEN 'no_visible_form4_accessions' END,
  CASE WHEN rows_with_open_market_buyers = 0 THEN 'no_open_market_form4_buyers' END, CASE WHEN forward_return_20d_coverage < 1 THEN 'incomplete_forward_return_20d' END,
  CASE WHEN forward_return_60d_coverage < 1 THEN 'incomplete_forward_return_60d' END, CASE WHEN forward_return_120d_coverage < 1 THEN 'incomplete_forward_return_120d' END) AS b,
  CASE WHEN row_count < 100 THEN 'sample_below_100_rows' ELSE '' END AS w FROM ev1)""",
    "k9_feature_summary": "SELECT count(*) AS rows, '13f_form4_joined' AS feature_scope FROM rowx",
    "u5_custom_metric": """SELECT split, baseline, round(avg(ret) FILTER (pos * 2 >= n), 6) AS better_half FROM (
  SELECT *, row_number() OVER (PARTITION BY split, baseline ORDER BY score, as_of, ticker) - 1 AS pos, count(*) OVER (PARTITION BY split, baseline) AS n FROM obs) GROUP BY ALL""",
}


def build() -> dict[str, str]:
    return {name: sql(body, **EXTRA) for name, body in SQL.items()}
