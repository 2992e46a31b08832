import bisect
import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.score import INSIDER_DEFAULTS, INSTITUTIONAL_DEFAULTS
from tidemark.operators import evidence, resample, research
from tidemark.params import DEFAULT_WEIGHTS, EXPORT_COLUMNS, REQUIRED_COLUMNS, TUNABLE_BOUNDS, Weights
from tidemark.streaming import jobs
from test_watch_streams import as_stream

T0 = dt.datetime(2024, 1, 1, 12)


def plain_weight(key, a, b):
    x = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % resample.PRIME
    return bisect.bisect_right(resample.poisson_steps(), (int(a) * x + int(b)) % resample.PRIME)


def test_sums_of_replicates_are_those_of_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["g", "h", None]), i, rng.random() if i % 7 else None) for i in range(300)] + [("g", 5, 1.0)]
    obs = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    got = {(r.g, r.replicate): (r.w, r.v) for r in resample.resampled_sums(obs, ["g"], ["i"], {"w": F.lit(1.0), "v": F.col("v")}, samples=6, seed=3).collect()}
    a, b = resample.replicate_factors(6, 3)
    for g in ("g", "h", None):
        own = [(str(i), v or 0.0) for k, i, v in rows if k == g]
        assert got[g, -1] == pytest.approx((len(own), sum(v for _, v in own)))
        for r in range(6):
            w = [plain_weight(i, a[r], b[r]) for i, _ in own]
            assert got[g, r] == pytest.approx((sum(w), sum(x * v for x, (_, v) in zip(w, own, strict=True))))
    assert len(got) == 3 * 7 and resample.resampled_sums(obs.limit(0), ["g"], ["i"], {"w": F.lit(1.0)}).count() == 0


def test_weights_are_poisson_and_intervals_hold_the_value(spark):
    a, b = resample.replicate_factors(40, 1)
    counts = [plain_weight(str(i), a[r], b[r]) for i in range(500) for r in range(40)]
    assert abs(sum(counts) / len(counts) - 1) < 0.03 and abs(counts.count(0) / len(counts) - 0.368) < 0.02
    rng = random.Random(4)
    rows = [("strong", i, x, 2 * x + rng.gauss(0, 0.3)) for i in range(400) for x in [rng.gauss(0, 1)]] + [("flat", i, 1.0, rng.random()) for i in range(20)]
    obs = spark.createDataFrame(rows, "g string, i int, x double, y double")
    got = {r.g: r for r in resample.metric_interval(obs, ["g"], ["g", "i"], resample.correlation_terms(F.col("x"), F.col("y")), resample.correlation).collect()}
    assert 0.95 < got["strong"].lo < got["strong"].value < got["strong"].hi < 1
    assert tuple(got["flat"]) == ("flat", None, None, None)


def observations(spark):
    rng = random.Random(6)
    base = {**INSTITUTIONAL_DEFAULTS, **INSIDER_DEFAULTS}
    rows = []
    for i in range(120):
        row = dict(base, as_of=dt.date(2024, 1, 1) + dt.timedelta(days=i), ticker=f"T{i}", funds_accumulating=rng.randint(0, 6), funds_trimming=rng.randint(0, 4), n_buyers=rng.randint(0, 3),
                   conviction_units=rng.random() * 4, recency_weighted_buy_usd=rng.random() * 1e6, sell_value_usd=rng.random() * 1e5, n_sellers=rng.randint(0, 2), days_since_last_buy=rng.randint(0, 60))
        row["ret"] = 0.05 * row["conviction_units"] - 0.02 * row["funds_accumulating"] + rng.gauss(0, 0.05)
        rows.append(row)
    return spark.createDataFrame([{k: float(v) if isinstance(v, (int, float)) and k not in ("funds_accumulating", "funds_trimming", "n_buyers", "n_sellers", "days_since_last_buy") else v for k, v in r.items()} for r in rows])


def test_sweep_reaches_what_its_weights_are_worth_and_stays_in_bounds(spark):
    obs, tie = observations(spark), ["as_of", "ticker"]
    rows = research.sweep_weights(obs, tie).collect()
    found = {r.weight: r.value for r in rows}
    assert set(found) == set(TUNABLE_BOUNDS) and all(low <= found[w] <= high for w, (low, high) in TUNABLE_BOUNDS.items())
    judged = {r.weight_set: r.objective for r in research.evaluate_weight_sets(obs, {"base": DEFAULT_WEIGHTS, "best": Weights(**found)}, tie).collect()}
    assert rows[0].objective_before == pytest.approx(judged["base"], abs=2e-6) and rows[0].objective_after == pytest.approx(judged["best"], abs=2e-6)
    assert rows[0].objective_after > rows[0].objective_before and found["institutional_breadth"] < 36 <= found["insider_cluster"]


def test_evidence_review_takes_its_figures_from_one_pass(spark):
    good = {c: "1" for c in (*REQUIRED_COLUMNS, *EXPORT_COLUMNS)} | {"as_of": "2024-05-01", "ticker": "AAPL"}
    rows = spark.createDataFrame([good, good | {"as_of": "never", "ticker": ""}])
    review = evidence.evidence_review(rows)
    assert review._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + review._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 1
    m, errors = evidence.manifest(rows).first(), {(r.field, r.error): r.n for r in evidence.row_errors(rows).collect()}
    assert m.row_error_count == sum(errors.values()) and errors["as_of", "invalid_date"] == 1 and errors["ticker", "missing_value"] == 1
    assert m.version_mismatch_count == sum(r.n for r in evidence.version_mismatches(rows).collect()) and m.status == "not_publishable"
    empty = evidence.manifest(rows.limit(0)).first()
    assert (empty.row_count, empty.row_error_count, empty.status) == (0, 0, "not_publishable")


def test_events_are_kept_once_and_cut(spark):
    rows = [("e1", "k" * 100, "t" * 300, T0, 0), ("e1", "k" * 100, "t" * 300, T0, 1), ("e2", "short", "", T0, 1)]
    df = spark.createDataFrame(rows, "id string, event_type string, title string, created_at timestamp, b int")
    log = jobs.updates_table(jobs.event_appends(as_stream(df, (0, 1), "b")), "events", "append")
    assert sorted((r.id, len(r.event_type), len(r.title)) for r in log.collect()) == [("e1", 80, 240), ("e2", 5, 0)]
