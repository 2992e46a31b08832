"""Rank statistics of scores against forward returns, with resampling.

Observations are rows (group..., score, ret, id columns). All statistics take whole
numbers as row weights, so a bootstrap replicate is the same rows with other weights.
Draws are hashes of (group, replicate, row), so a repeated task draws the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.score import add_score, fill_missing_side, pillars
from tidemark.functions.values import finite_double
from tidemark.operators import ranking
from tidemark.params import BASELINES, DEFAULT_WEIGHTS, QUADRANT_RANK, TUNABLE_BOUNDS, Weights
from tidemark.session import materialize

QUANTILES = 5
BOOTSTRAP_SAMPLES, BOOTSTRAP_SEED = 250, 13
SHUFFLES, SHUFFLE_SEED = 500, 17
MIN_RESAMPLE_ROWS = 8


def baseline_rows(features: DataFrame, horizon: int = 60) -> DataFrame:
    """One row per (split, baseline, as_of, ticker) with the score the baseline ranks by."""
    ranks = None
    for name, value in QUADRANT_RANK.items():
        cond = F.lower(F.trim("quadrant")) == name
        ranks = F.when(cond, value) if ranks is None else ranks.when(cond, value)
    entries = [
        F.struct(F.lit(name).alias("baseline"), finite_double(c).alias("score")) for name, c in BASELINES.items()
    ] + [F.struct(F.lit("quadrant_only").alias("baseline"), ranks.alias("score"))]
    return (
        features.withColumn("ret", finite_double(f"forward_return_{horizon}d"))
        .filter(F.col("ret").isNotNull() & ~F.col("split").isin("invalid", "outside"))
        .select("split", "as_of", "ticker", "ret", F.explode(F.array(*entries)).alias("b"))
        .select("split", "b.baseline", "as_of", "ticker", "b.score", "ret")
        .filter("score is not null")
    )


def rank_pairs(obs: DataFrame, group: Sequence[str], weight: str | None = None) -> DataFrame:
    """Add centered average ranks of score (``rx``) and return (``ry``). Average ranks
    always have the mean (total + 1) / 2, so no second pass is needed to center them."""
    def centered(value: str, name: str) -> DataFrame:
        r = ranking.average_ranks(obs, group, value, weight)
        return r.select(*group, value, (F.col("rank") - (F.col("total") + 1) / 2).alias(name))

    return obs.join(centered("score", "rx"), [*group, "score"]).join(centered("ret", "ry"), [*group, "ret"])


def rank_ic(obs: DataFrame, group: Sequence[str], weight: str | None = None) -> DataFrame:
    """Spearman correlation per group; 0 with fewer than two rows or no variance."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = rank_pairs(obs, group, weight).groupBy(*group).agg(
        F.sum(w * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(w * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum(w * F.col("ry") * F.col("ry")).alias("yy"),
    )
    flat = (F.col("xx") == 0) | (F.col("yy") == 0)
    return sums.select(
        *group, F.when(flat, 0.0).otherwise(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))).alias("rank_ic")
    )


def bucket_metrics(obs: DataFrame, group: Sequence[str], tie: Sequence[str], q: int = QUANTILES,
                   weight: str | None = None) -> DataFrame:
    """Mean return of the top minus the bottom bucket and share of positive returns in the
    top, for buckets of ``n // q`` rows in score order; ties follow the ``tie`` columns."""
    rows = obs.withColumn("_w", F.lit(1).cast("long") if weight is None else F.col(weight))
    placed = ranking.weight_before(rows, group, ["score", *tie], "_w")
    size = F.greatest(F.lit(1), F.floor(F.col("total") / q))
    after = F.col("before") + F.col("_w")
    in_bottom = F.greatest(F.least(after, size) - F.col("before"), F.lit(0))
    in_top = F.greatest(after - F.greatest(F.col("before"), F.col("total") - size), F.lit(0))
    sums = (
        placed.withColumns({"_b": in_bottom, "_t": in_top, "_size": size})
        .groupBy(*group)
        .agg(
            F.max("total").alias("n"),
            F.max("_size").alias("size"),
            F.sum(F.col("_t") * F.col("ret")).alias("top"),
            F.sum(F.col("_b") * F.col("ret")).alias("bottom"),
            F.sum(F.when(F.col("ret") > 0, F.col("_t")).otherwise(0)).alias("hits"),
            F.sum(F.col("_w") * F.col("ret")).alias("all"),
        )
    )
    enough = F.col("n") >= q
    return sums.select(
        *group, "n",
        F.when(enough, F.col("top") / F.col("size") - F.col("bottom") / F.col("size")).otherwise(0.0).alias("top_bottom_spread"),
        F.when(enough, F.col("hits") / F.col("size")).otherwise(0.0).alias("hit_rate"),
        (F.col("all") / F.col("n")).alias("mean_forward_return"),
    )


def metrics(obs: DataFrame, group: Sequence[str], tie: Sequence[str], q: int = QUANTILES) -> DataFrame:
    """n, rank IC, spread, hit rate and mean return per group."""
    return bucket_metrics(obs, group, tie, q, None).join(rank_ic(obs, group, None), list(group))


# -- resampling -----------------------------------------------------------------
def draw(seed: int, *parts: Column) -> Column:
    """Repeatable whole number from the md5 of the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _numbered(obs: DataFrame, group: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rows with their position in the group and the group size, groups of at least 8."""
    return ranking.positions(obs, group, tie).filter(F.col("total") >= MIN_RESAMPLE_ROWS)


def bootstrap_replicates(obs: DataFrame, group: Sequence[str], tie: Sequence[str],
                         samples: int = BOOTSTRAP_SAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Rows with how often each replicate drew them. Every row draws once per replicate;
    the draws are counted before they meet the rows again."""
    g = list(group)
    rows = _numbered(obs, g, tie)
    drawn = (
        rows.select(*g, "position", "total", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
        .withColumn("position", draw(seed, *[F.col(c) for c in g], F.col("replicate"), F.col("position")) % F.col("total"))
        .groupBy(*g, "replicate", "position")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return rows.drop("total").join(drawn, [*g, "position"])


def _interval(values: str, samples: int, name: str) -> Column:
    """Order statistics at 2.5 % and 97.5 % of the replicates of a group."""
    ordered = F.sort_array(F.collect_list(values))
    pick = lambda p: F.round(F.element_at(ordered, int(p * (samples - 1)) + 1), 6)
    return F.struct(pick(0.025).alias("lo"), pick(0.975).alias("hi")).alias(name)


def bootstrap_ci(obs: DataFrame, group: Sequence[str], tie: Sequence[str], samples: int = BOOTSTRAP_SAMPLES,
                 q: int = QUANTILES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """95 % intervals of rank IC and spread; (0, 0) below eight rows."""
    g = list(group)
    reps = materialize(bootstrap_replicates(obs, g, tie, samples, seed), "bootstrap")
    keys = [*g, "replicate"]
    stats = rank_ic(reps, keys, "weight").join(
        bucket_metrics(reps, keys, ["position"], q, "weight"), keys)
    ci = stats.groupBy(*g).agg(
        _interval("rank_ic", samples, "ic"), _interval("top_bottom_spread", samples, "spread")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return obs.select(*g).distinct().join(ci, g, "left").select(
        *g, zero("ic.lo").alias("ic_lo"), zero("ic.hi").alias("ic_hi"),
        zero("spread.lo").alias("spread_lo"), zero("spread.hi").alias("spread_hi"),
    )


def permutation_pvalue(obs: DataFrame, group: Sequence[str], tie: Sequence[str],
                       samples: int = SHUFFLES, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Share of shuffles whose |rank IC| reaches the observed one, counting the observed
    one; 1 below eight rows. A shuffle permutes ranks, so ranks are computed once."""
    g = list(group)
    ranked = materialize(_numbered(rank_pairs(obs, g, None), g, tie).select(*g, "position", "rx", "ry"), "ranks")
    norms = ranked.groupBy(*g).agg(
        (F.sqrt(F.sum(F.col("rx") * F.col("rx"))) * F.sqrt(F.sum(F.col("ry") * F.col("ry")))).alias("norm"),
        F.sum(F.col("rx") * F.col("ry")).alias("xy"),
    )
    shuffled = ranked.select(
        *g, "position", "rx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate")
    ).withColumn("key", draw(seed, *[F.col(c) for c in g], F.col("replicate"), F.col("position")))
    target = (
        ranking.weight_before(shuffled.withColumn("n", F.lit(1)), [*g, "replicate"], ["key", "position"], "n")
        .select(*g, "replicate", "rx", F.col("before").cast("long").alias("position"))
    )
    per_replicate = (
        target.join(ranked.select(*g, F.col("position").cast("long").alias("position"), "ry"), [*g, "position"])
        .groupBy(*g, "replicate")
        .agg(F.sum(F.col("rx") * F.col("ry")).alias("sxy"))
        .join(norms, g)
    )
    # Ranks are multiples of one half, so the sums compare exactly.
    reached = F.count_if(F.abs("sxy") >= F.abs("xy"))
    p = per_replicate.groupBy(*g).agg(F.round((reached + 1) / (samples + 1), 6).alias("p"))
    return obs.select(*g).distinct().join(p, g, "left").select(
        *g, F.coalesce("p", F.lit(1.0)).alias("rank_ic_permutation_p")
    )


# -- weight search ----------------------------------------------------------------
def score_with_weight_sets(observations: DataFrame, sets: Mapping[str, Weights]) -> DataFrame:
    """Every observation scored by every weight set of a short list."""
    variants = F.explode(
        F.array(*[
            F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in w.as_dict().items()])
            for name, w in sets.items()
        ])
    )
    out = fill_missing_side(observations).withColumn("_w", variants)
    weights = {k: F.col(f"_w.{k}") for k in DEFAULT_WEIGHTS.as_dict()}
    return add_score(out, weights).withColumn("weight_set", F.col("_w.name")).drop("_w")


def evaluate_weight_sets(observations: DataFrame, sets: Mapping[str, Weights], tie: Sequence[str],
                         q: int = QUANTILES) -> DataFrame:
    """IC, spread, hit rate and objective (IC + half the spread) of each weight set."""
    scored = score_with_weight_sets(observations, sets).select("weight_set", "score", "ret", *tie)
    return metrics(scored, ["weight_set"], tie, q).select(
        "weight_set", "n",
        F.col("rank_ic").alias("ic"), F.col("top_bottom_spread").alias("quantile_spread"), "hit_rate",
        (F.col("rank_ic") + 0.5 * F.col("top_bottom_spread")).alias("objective"),
    )


def optimize_weights(observations: DataFrame, tie: Sequence[str], base: Weights = DEFAULT_WEIGHTS,
                     passes: int = 6, q: int = QUANTILES) -> tuple[Weights, float, float]:
    """Coordinate search within bounds, steps 8, 4, 2, 1. Both candidates of a weight are
    judged in one job; the driver sees one objective per candidate."""
    obs = materialize(fill_missing_side(observations), "observations")

    def objective(sets: Mapping[str, Weights]) -> dict[str, float]:
        return {r["weight_set"]: r["objective"] for r in evaluate_weight_sets(obs, sets, tie, q).collect()}

    best = base
    start = best_value = objective({"base": base})["base"]
    steps = (8.0, 4.0, 2.0, 1.0)
    for number in range(passes):
        step, improved = steps[min(number, len(steps) - 1)], False
        for name, (low, high) in TUNABLE_BOUNDS.items():
            now = getattr(best, name)
            tried = {}
            for label, delta in (("up", step), ("down", -step)):
                value = min(high, max(low, now + delta))
                if value != now:
                    tried[label] = best.with_(**{name: value})
            values = objective(tried) if tried else {}
            for label in ("up", "down"):
                if label in values and values[label] > best_value + 1e-9:
                    best, best_value, improved = tried[label], values[label], True
        if not improved:
            break
    return best, start, best_value


# -- weight sweep -------------------------------------------------------------------
#: Steps of a sweep, one pass each.
SWEEP_STEPS = (8.0, 4.0, 2.0, 1.0)


def unit_pillars(observations: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Each observation with what its pillars are per unit of each tunable weight. A score is the sum of
    weights times units, so the pillars are computed once for all weights."""
    one = Weights(**{w: 1.0 for w in TUNABLE_BOUNDS}).as_dict()
    out = fill_missing_side(observations).withColumns(pillars(one))
    apart = lambda w: pillars({**one, w: 0.0})["penalty_score"]
    return out.select(
        *tie, "ret", F.col("institutional_score").alias("institutional_breadth"), F.col("insider_score").alias("insider_cluster"),
        F.col("dollar_score").alias("dollar_conviction"), F.col("agreement_score").alias("agreement_bonus"),
        apart("insider_sell_penalty").alias("institutional_trim_penalty"), apart("institutional_trim_penalty").alias("insider_sell_penalty"))


def sweep_weights(observations: DataFrame, tie: Sequence[str], base: Weights = DEFAULT_WEIGHTS, steps: Sequence[float] = SWEEP_STEPS,
                  q: int = QUANTILES) -> DataFrame:
    """Search of the tunable weights, a pass per step: every weight one step up and one down, within its
    bounds, and the weights as they are, all judged in one job. The best of these is where the next pass
    starts; of equals the first. One row per weight, with the objective before and after.

    Pillars and the ranks of returns are computed once. The best weights stay a one-row table."""
    names = list(TUNABLE_BOUNDS)
    units = unit_pillars(observations, tie)
    ranks = ranking.average_ranks(units, [], "ret").select("ret", (F.col("rank") - (F.col("total") + 1) / 2).alias("ry"))
    units = materialize(units.join(ranks, "ret"), "units")
    first = observations.sparkSession.range(1)
    best = first.select(F.struct(*(F.lit(float(getattr(base, w))).alias(w) for w in names)).alias("w"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))
    for step in steps:
        best = materialize(_sweep(units, best, tie, float(step), q), "best-weights")
    return best.select(F.explode(F.array(*(F.struct(F.lit(w).alias("weight"), F.col(f"w.{w}").alias("value")) for w in names))).alias("e"), "before", "after").select(
        "e.weight", "e.value", F.round("before", 6).alias("objective_before"), F.round("after", 6).alias("objective_after"))


def _sweep(units: DataFrame, best: DataFrame, tie: Sequence[str], step: float, q: int) -> DataFrame:
    names = list(TUNABLE_BOUNDS)

    def moved(w: Column, which: str | None, by: float) -> Column:
        values = [(F.least(F.lit(TUNABLE_BOUNDS[n][1]), F.greatest(F.lit(TUNABLE_BOUNDS[n][0]), w[n] + by)) if n == which else w[n]).alias(n) for n in names]
        return F.struct(*values)

    tried = [(None, 0.0), *((n, by) for n in names for by in (step, -step))]
    choices = F.array(*(F.struct(F.lit(i).alias("place"), moved(F.col("w"), n, by).alias("w")) for i, (n, by) in enumerate(tried)))
    candidates = best.select(F.explode(choices).alias("c")).select("c.*")
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(f"c.w.{n}") * F.col(n)
    scored = units.withColumn("c", F.explode(best.select(choices.alias("c")).scalar())).select(
        F.col("c.place").alias("place"), *tie, "ret", "ry", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 6).alias("score"))
    scored = materialize(scored, "scored-candidates")
    ranks = ranking.average_ranks(scored, ["place"], "score").select("place", "score", (F.col("rank") - (F.col("total") + 1) / 2).alias("rx"))
    sums = scored.join(ranks, ["place", "score"]).groupBy("place").agg(
        F.sum(F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("ry") * F.col("ry")).alias("yy"))
    ic = F.when((F.col("xx") == 0) | (F.col("yy") == 0), 0.0).otherwise(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")))
    spread = bucket_metrics(scored, ["place"], tie, q).select("place", "top_bottom_spread")
    judged = sums.join(spread, "place").select("place", F.round(ic + 0.5 * F.col("top_bottom_spread"), 9).alias("objective")).join(candidates, "place")
    start = best.select("before").scalar()
    return judged.agg(
        F.max_by("w", F.struct("objective", -F.col("place"))).alias("w"),
        F.max(F.when(F.col("place") == 0, F.col("objective"))).alias("now"), F.max("objective").alias("after"),
    ).select("w", F.coalesce(start, F.col("now")).alias("before"), "after")
