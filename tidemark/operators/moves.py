"""Quarter-over-quarter moves of every fund in one pass.

Each position is sent to the quarter it belongs to and to the fund's next stored
quarter, and one hash aggregation per (fund, quarter, security, put/call) puts the two
sides together. That is a full outer join without reading the positions twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.texts import format_usd
from tidemark.params import HOLD_EPSILON

BUYS = ("NEW", "ADD")
SELLS = ("EXIT", "TRIM")


def classify(prev_shares: Column, curr_shares: Column, in_prev: Column, in_curr: Column,
             hold_epsilon: float = HOLD_EPSILON) -> Column:
    """NEW / EXIT / HOLD / ADD / TRIM from share counts."""
    rel = F.when(prev_shares != 0, (curr_shares - prev_shares) / prev_shares).otherwise(0.0)
    return (
        F.when(in_curr & ~in_prev, "NEW")
        .when(in_prev & ~in_curr, "EXIT")
        .when(F.abs(rel) <= hold_epsilon, "HOLD")
        .when(rel > 0, "ADD")
        .otherwise("TRIM")
    )


def _finish(df: DataFrame, hold_epsilon: float) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = df.withColumns(
        {c: zero(c) for c in ("prev_shares", "curr_shares", "prev_value", "curr_value", "curr_weight")}
    )
    return out.withColumns(
        {
            "move": classify(F.col("prev_shares"), F.col("curr_shares"), F.col("in_prev"),
                             F.col("in_curr"), hold_epsilon),
            "share_change_pct": F.when(
                F.col("prev_shares") != 0,
                (F.col("curr_shares") - F.col("prev_shares")) / F.col("prev_shares"),
            ),
        }
    ).drop("in_prev", "in_curr")


def quarter_moves(snapshots: DataFrame, hold_epsilon: float = HOLD_EPSILON) -> DataFrame:
    """Moves of all funds in all quarters. ``snapshots`` are resolved positions with
    ``next_report_date``. A fund's first quarter is all NEW."""
    texts = [c for c in ("issuer", "title_of_class", "ticker") if c in snapshots.columns]
    has_weight = "weight" in snapshots.columns
    # The filing that reports the quarter travels along, so an EXIT knows it too.
    filed = [("accession", "next_accession"), ("filing_date", "next_filing_date")]
    filed = filed if "next_accession" in snapshots.columns else []
    sides = F.explode(
        F.array(
            F.struct(F.lit(True).alias("curr"), F.col("report_date").alias("quarter"),
                     *[F.col(now).alias(now) for now, _ in filed]),
            F.struct(F.lit(False).alias("curr"), F.col("next_report_date").alias("quarter"),
                     *[F.col(later).alias(now) for now, later in filed]),
        )
    ).alias("side")
    weight = F.col("weight") if has_weight else F.lit(0.0)
    sided = snapshots.select(
        "cik", "cusip", "put_call", "shares", "value_usd", weight.alias("weight"), *texts, sides
    ).filter("side.quarter is not null")
    curr, prev = F.col("side.curr"), ~F.col("side.curr")
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    moves = sided.groupBy(
        "cik", F.col("side.quarter").alias("report_date"), "cusip", "put_call"
    ).agg(
        F.max(curr).alias("in_curr"),
        F.max(prev).alias("in_prev"),
        pick(prev, "shares").alias("prev_shares"),
        pick(curr, "shares").alias("curr_shares"),
        pick(prev, "value_usd").alias("prev_value"),
        pick(curr, "value_usd").alias("curr_value"),
        pick(curr, "weight").alias("curr_weight"),
        *[F.coalesce(pick(curr, c), pick(prev, c)).alias(c) for c in texts],
        *[F.max(f"side.{now}").alias(now) for now, _ in filed],
    )
    return _finish(moves, hold_epsilon)


def fund_moves(snapshots: DataFrame, hold_epsilon: float = HOLD_EPSILON) -> DataFrame:
    """What ``quarter_moves`` gives, for ``fund_snapshots``: one row per fund, quarter, security and put/call.

    The rows of a security are sorted by quarter, and each looks at the one before and the one after. Only an
    EXIT makes a row of its own, and rows that are dealt out by ``cik`` do not move again."""
    texts = [c for c in ("issuer", "title_of_class", "ticker") if c in snapshots.columns]
    # The hash sorts securities apart without comparing their texts.
    key = ["cik", "cusip", "put_call"]
    row = Window.partitionBy("_row", *key).orderBy("report_date")
    before = lambda c: F.lag(c).over(row)
    looked = snapshots.withColumn("_row", F.xxhash64(*key)).withColumns({
        "_here": F.coalesce(before("next_report_date") == F.col("report_date"), F.lit(False)), "_after": F.lead("report_date").over(row),
        **{f"_{c}": before(c) for c in ("shares", "value_usd", *texts)}})
    gone = F.col("next_report_date").isNotNull() & ~F.coalesce(F.col("_after") == F.col("next_report_date"), F.lit(False))
    sides = F.explode(F.when(gone, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("in_curr")
    curr, both = F.col("in_curr"), F.col("in_curr") & F.col("_here")
    now = lambda c: F.when(curr, F.col(c))
    old = lambda c: F.when(~curr, F.col(c)).when(F.col("_here"), F.col(f"_{c}"))
    filed = lambda c: F.when(curr, F.col(c)).otherwise(F.col(f"next_{c}")).alias(c)
    moves = looked.select("*", sides).select(
        "cik", filed("report_date"), "cusip", "put_call", "in_curr", (~curr | both).alias("in_prev"),
        old("shares").alias("prev_shares"), now("shares").alias("curr_shares"), old("value_usd").alias("prev_value"),
        now("value_usd").alias("curr_value"), now("weight").alias("curr_weight"),
        *[F.coalesce(F.col(c), F.when(both, F.col(f"_{c}"))).alias(c) for c in texts], filed("accession"), filed("filing_date"))
    return _finish(moves, hold_epsilon)


def diff_portfolios(prev: DataFrame, curr: DataFrame, hold_epsilon: float = HOLD_EPSILON) -> DataFrame:
    """Moves between two given sets of positions, matched on (cusip, put_call)."""
    cols = ["cusip", "put_call", "shares", "value_usd"]
    p = prev.select(*cols, "issuer").toDF("cusip", "put_call", "prev_shares", "prev_value", "prev_issuer")
    c = curr.select(*cols, "weight", "issuer").toDF(
        "cusip", "put_call", "curr_shares", "curr_value", "curr_weight", "curr_issuer"
    )
    both = (
        p.withColumn("in_prev", F.lit(True))
        .join(c.withColumn("in_curr", F.lit(True)), ["cusip", "put_call"], "full_outer")
        .withColumns(
            {
                "in_prev": F.coalesce("in_prev", F.lit(False)),
                "in_curr": F.coalesce("in_curr", F.lit(False)),
                "issuer": F.coalesce("curr_issuer", "prev_issuer"),
            }
        )
        .drop("prev_issuer", "curr_issuer")
    )
    return _finish(both, hold_epsilon)


def move_size(move: Column | None = None) -> Column:
    """Sort key inside a move class: dollars for NEW/EXIT/HOLD, share change for ADD/TRIM."""
    move = F.col("move") if move is None else move
    return F.when(
        move.isin("NEW", "EXIT", "HOLD"), F.greatest("curr_value", "prev_value")
    ).otherwise(F.abs(F.coalesce(F.col("share_change_pct"), F.lit(0.0))))


def rank_moves(moves: DataFrame, *keys: str) -> DataFrame:
    """Order of moves within (keys, move class), largest first."""
    order = Window.partitionBy(*keys, "move").orderBy(move_size().desc(), "cusip", "put_call")
    return moves.withColumn("move_rank", F.row_number().over(order))


def move_counts(moves: DataFrame, *keys: str) -> DataFrame:
    """Number of moves of each class per key."""
    return moves.groupBy(*keys).agg(
        *[F.count_if(F.col("move") == m).alias(f"n_{m.lower()}") for m in ("NEW", "ADD", "TRIM", "EXIT", "HOLD")]
    )


def ticker_summary(moves: DataFrame, *keys: str, weights: bool = False) -> DataFrame:
    """Holders, buyers, sellers, openings, exits and value of long positions per key; with ``weights`` also the
    mean weight of positions held (``avg_weight``) and the sorted kinds of moves (``movement_codes``).

    Several distinct counts at once would copy every row once per count, so positions are
    first folded to one row per (key, fund) and the flags of the funds are counted.
    """
    did = lambda *kinds: F.max(F.col("move").isin(*kinds))
    kept, held = [], F.when(F.col("move") != "EXIT", F.col("curr_weight"))
    per_move = [did("ADD").alias("added"), did("HOLD").alias("kept"), did("TRIM").alias("trimmed"),
                F.sum(held).alias("weight"), F.count(held).alias("n_weights")] if weights else []
    if weights:
        codes = {"ADD": "added", "EXIT": "exited", "HOLD": "kept", "NEW": "opened", "TRIM": "trimmed"}
        kept = [F.try_divide(F.sum("weight"), F.sum("n_weights")).alias("avg_weight"),
                F.array_compact(F.array(*(F.when(F.max(c), F.lit(code)) for code, c in codes.items()))).alias("movement_codes")]
    per_fund = moves.filter("put_call = ''").groupBy(*keys, "cik").agg(
        did("NEW", "ADD", "HOLD", "TRIM").alias("holds"), did("NEW", "ADD").alias("bought"),
        did("EXIT", "TRIM").alias("sold"), did("NEW").alias("opened"), did("EXIT").alias("exited"),
        F.sum("curr_value").alias("value"), *per_move,
    )
    return per_fund.groupBy(*keys).agg(
        F.count_if("holds").alias("holder_count"),
        F.count_if("bought").alias("buyers_count"),
        F.count_if("sold").alias("sellers_count"),
        F.count_if("opened").alias("new_positions"),
        F.count_if("exited").alias("exits"),
        F.sum("value").alias("total_value_usd"), *kept,
    )


def move_detail() -> Column:
    """'NEW $1.2B', '+45% shares', with the option side in brackets."""
    pct = F.round(F.col("share_change_pct") * 100, 0).cast("long")
    signed = F.concat(F.when(F.col("share_change_pct") < 0, "-").otherwise("+"),
                      F.abs(pct).cast("string"), F.lit("% shares"))
    base = (
        F.when(F.col("move") == "NEW", F.concat(F.lit("NEW "), format_usd(F.col("curr_value"))))
        .when(F.col("move") == "EXIT", F.concat(F.lit("EXIT "), format_usd(F.col("prev_value"))))
        .otherwise(F.coalesce(signed, F.col("move")))
    )
    option = F.when(F.col("put_call") != "", F.concat(F.lit(" ["), F.col("put_call"), F.lit("]")))
    return F.concat(base, F.coalesce(option, F.lit("")))
