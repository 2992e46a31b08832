import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, research
from tidemark.params import DEFAULT_WEIGHTS, TUNABLE_BOUNDS


def brute_ranks(xs):
    s = sorted(xs)
    return [(s.index(x) + 1 + len(s) - s[::-1].index(x)) / 2 for x in xs]


def brute_ic(a, b):
    n, ra, rb = len(a), brute_ranks(a), brute_ranks(b)
    ma, mb = sum(ra) / n, sum(rb) / n
    cov = sum((x - ma) * (y - mb) for x, y in zip(ra, rb))
    va, vb = sum((x - ma) ** 2 for x in ra) ** 0.5, sum((y - mb) ** 2 for y in rb) ** 0.5
    return cov / (va * vb) if va and vb else 0.0


@pytest.fixture(scope="module")
def obs(spark):
    rnd = random.Random(5)
    # One score value holds a third of the rows, and one group most of them.
    rows = [("big" if i % 10 else "small", i, 0.0 if rnd.random() < 0.33 else round(rnd.gauss(0, 1), 2), round(rnd.gauss(0, 1), 1)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, id bigint, score double, ret double").repartition(5)


def test_ranks_and_positions_equal_brute_force(obs):
    rows, df = obs
    for g in ("big", "small"):
        mine = [r for r in rows if r[0] == g]
        want = dict(zip([r[2] for r in mine], brute_ranks([r[2] for r in mine])))
        got = {r.score: r.rank for r in ranking.average_ranks(df, ["g"], "score").filter(F.col("g") == g).collect()}
        assert got == want
        order = [r[1] for r in sorted(mine, key=lambda r: (r[2], r[1]))]
        pos = {r.id: r.position for r in ranking.positions(df, ["g"], ["score", "id"]).filter(F.col("g") == g).collect()}
        assert [i for i, _ in sorted(pos.items(), key=lambda x: x[1])] == order and sorted(pos.values()) == list(range(len(mine)))


def test_metrics_equal_brute_force(obs):
    rows, df = obs
    got = {r.g: r for r in research.metrics(df, ["g"], ["id"]).collect()}
    for g, m in got.items():
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        k = len(mine) // 5
        top, bottom = [r[3] for r in mine[-k:]], [r[3] for r in mine[:k]]
        assert m.rank_ic == pytest.approx(brute_ic([r[2] for r in mine], [r[3] for r in mine]))
        assert m.top_bottom_spread == pytest.approx(sum(top) / k - sum(bottom) / k)
        assert m.hit_rate == pytest.approx(sum(x > 0 for x in top) / k) and m.n == len(mine)


def test_degenerate_groups(spark):
    rows = [("flat", i, 1.0, float(i)) for i in range(6)] + [("one", 0, 1.0, 1.0)] + [("few", i, float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id bigint, score double, ret double")
    got = {r.g: (r.rank_ic, r.top_bottom_spread, r.hit_rate) for r in research.metrics(df, ["g"], ["id"]).collect()}
    assert got["flat"][0] == 0.0 and got["one"] == (0.0, 0.0, 0.0) and got["few"] == (pytest.approx(1.0), 0.0, 0.0)
    ci = {r.g: (r.ic_lo, r.ic_hi) for r in research.bootstrap_ci(df, ["g"], ["id"], samples=20).collect()}
    assert ci == {"flat": (0.0, 0.0), "one": (0.0, 0.0), "few": (0.0, 0.0)}
    assert {r.rank_ic_permutation_p for r in research.permutation_pvalue(df, ["g"], ["id"], samples=20).collect()} == {1.0}


def test_resampling_on_a_strong_signal(spark):
    rows = [("s", i, float(i), i + (7 * i % 5)) for i in range(60)] + [("n", i, float(i), float((i * 37) % 60)) for i in range(60)]
    df = spark.createDataFrame([(g, i, s, float(r)) for g, i, s, r in rows], "g string, id bigint, score double, ret double")
    ci = {r.g: r for r in research.bootstrap_ci(df, ["g"], ["id"], samples=60).collect()}
    assert 0.95 < ci["s"].ic_lo <= ci["s"].ic_hi <= 1.0 and ci["n"].ic_lo < ci["n"].ic_hi
    p = {r.g: r.rank_ic_permutation_p for r in research.permutation_pvalue(df, ["g"], ["id"], samples=99).collect()}
    assert p["s"] == 0.01 and 0 < p["n"] <= 1
    again = {r.g: r.rank_ic_permutation_p for r in research.permutation_pvalue(df.repartition(3), ["g"], ["id"], samples=99).collect()}
    assert again == p  # draws do not depend on the layout


def test_weight_search_never_gets_worse(spark):
    rnd = random.Random(3)
    rows = [(i, i % 5, i % 3, rnd.random() * 3, float(rnd.randrange(0, 10 ** 6)), rnd.gauss(0, 0.02) + 0.02 * (i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, funds_accumulating bigint, n_buyers bigint, conviction_units double, recency_weighted_buy_usd double, ret double")
    best, before, after = research.optimize_weights(df, ["id"], passes=1)
    assert after >= before
    assert all(lo <= getattr(best, n) <= hi for n, (lo, hi) in TUNABLE_BOUNDS.items())
    same = research.evaluate_weight_sets(df, {"a": DEFAULT_WEIGHTS, "b": DEFAULT_WEIGHTS}, ["id"]).collect()
    assert same[0].objective == same[1].objective
