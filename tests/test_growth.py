"""Steps that must not grow faster than their input: what plans move, and how often they read."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tests.test_insider_score import FORM4, TXN
from tidemark.operators import insider
from tidemark.sources import documents

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once_and_do_not_move(spark):
    """narrow rows are dealt out, documents are made of them and parsed in place."""
    for name in ("k8_form4_summary", "k8_form4_rows", "p13_issuer_guard", "s3_form4_xml", "s1_info_table_xml"):
        text = plan(entry.queries()[name](spark, SF))
        assert text.count("from_xml(") == 1, name
        above = text[:text.index("from_xml(")]
        assert "Repartition" not in above, name
        moved = text[text.index("from_xml("):].split("Repartition", 1)[1].splitlines()[1]
        assert "ownershipDocument" not in moved and "informationTable" not in moved, name


def test_only_named_columns_are_parsed_and_agree(spark):
    docs = spark.createDataFrame([("a", "", FORM4.format(TXN.format("P", "50,000", "84") + TXN.format("m", "1", "10"))),
                                  ("b", "", FORM4.format(TXN.format("S", "7", "x"))[:-9]), ("c", "2026-05-21", FORM4.format(TXN.format("S", "7", "x")))],
                                 "accession string, filing_date string, xml string")
    whole = documents.parse_form4(docs)
    for names in (["issuer_cik"], ["shares", "filing_date"], ["is_officer", "direct", "owner_cik"]):
        some = documents.parse_form4(docs, columns=names, dealt=True)
        assert sorted(some.columns) == sorted(["accession", *names])
        assert sorted(map(tuple, some.select("accession", *names).collect())) == sorted(map(tuple, whole.select("accession", *names).collect()))
    assert "officerTitle" not in plan(documents.parse_form4(docs, columns=["issuer_cik"]))


def test_build_summary_counts_copies_and_missing_ciks(spark):
    row = lambda t, cik, acc, day="2024-02-01": (t, cik, acc, "I", "1", day, day)
    parsed = spark.createDataFrame(
        [row("A", "1", "x"), row("A", "1", "x"), row("A", "9", "y"), row("A", "9", "y"), row("A", "1", "z", "2030-01-01"), row("C", "1", "w"), row("D", "4", "v")],
        "ticker string, issuer_cik string, accession string, issuer_name string, owner_cik string, filing_date string, transaction_date string")
    universe = spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "ticker string")
    ciks = spark.createDataFrame([("A", "0000000001"), ("B", "0000000002")], "ticker string, cik string")
    day = lambda d: F.lit(d).cast("date")
    got = insider.form4_build_summary(parsed, universe, ciks, day("2024-01-01"), day("2024-12-31")).first().asDict()
    assert got == {"tickers_requested": 3, "tickers_without_cik": 1, "tickers_without_filings": 1, "issuer_mismatch_filings": 1, "rows_new": 2}


def test_export_makes_moves_and_prices_once(spark, monkeypatch):
    """F2, F4 to F11, F14, F15: a feature export reads stored moves and prices, and moves visible filings once."""
    from tidemark.plans.driver_tables import Tables
    from tidemark.plans.score_queries import _export

    made = []
    for name in ("moves", "prices"):
        real = getattr(Tables, name)
        monkeypatch.setattr(Tables, name, lambda self, *a, _n=name, _r=real, **k: made.append(_n) or _r(self, *a, **k))
    text = plan(_export(Tables(spark, SF)))
    assert sorted(made) == ["moves", "prices"]
    # Only the trades are derived in the plan itself: lines are read there once.
    assert text.count("l_shipdate") and sum("Relation" in x and "l_orderkey" in x for x in text.splitlines()) == 1


def test_digests_of_lists_folded_where_their_key_is(spark):
    from tidemark.operators.digests import list_digests

    rows = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("l", ""), ("l", None), ("m", None)], "k string, x string").repartition(3)
    early, late = (sorted(map(tuple, list_digests(rows, ["k"], "x", texts={"t": "x"}, combine=c).collect())) for c in (True, False))
    assert early == late and [(r[0], r[1], r[3]) for r in late] == [("k", 2, "a;b"), ("l", 1, "")]
    moved = list_digests(rows, ["k"], "x", combine=False)._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange hashpartitioning") == 1


def test_moves_of_funds_dealt_out_once(spark):
    """F5 to F10: lines move once, by fund; windows inside a fund give what the filing tables give, also when filings tie or are small."""
    from tidemark.operators import holdings
    from tidemark.operators.moves import quarter_moves

    line = lambda cik, day, form, filed, cusip, value: (f"{cik}{day}{form}", cik, day, form, filed, cusip, "", value, 1.0, cusip, "COM", cusip)
    rows = [line("1", "2024-03-31", "A", "2024-05-01", c, v) for c, v in (("x", 1.0), ("y", 3.0), ("z", 0.0))]
    rows += [line("1", "2024-03-31", "B", "2024-06-01", "x", 9.0)]  # newer, but under half of the positions
    rows += [line("1", "2024-09-30", "A", "2024-11-01", c, 0.0) for c in "xw"]
    rows += [line("1", "2024-09-30", "B", "2024-11-01", c, 2.0) for c in "xv"]  # the same day: the greater accession
    rows += [line("1", "2024-12-31", "A", "2025-02-01", "v", 5.0), line("2", "2024-03-31", "A", "2024-05-01", "x", 7.0)]
    positions = spark.createDataFrame(rows, "accession string, cik string, report_date string, form string, filing_date string, cusip string, put_call string, "
                                      "value_usd double, shares double, issuer string, title_of_class string, ticker string").withColumns(
        {c: F.to_date(c) for c in ("report_date", "filing_date")})
    filings = holdings.filing_totals(positions)
    snap = holdings.snapshot(holdings.add_weights(positions, filings), holdings.quarter_chain(holdings.resolve_filings(filings)))
    want, got = quarter_moves(snap), quarter_moves(holdings.fund_snapshots(positions))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 10
    dealt = quarter_moves(holdings.fund_snapshots(positions.repartition("cik")))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_activity_moves_trades_once_and_agrees(spark):
    """F5 to F10: trades dealt out by (ticker, owner) are folded and summed per owner in place."""
    from tidemark.plans.driver_tables import Tables

    trades = Tables(spark, SF).trades().localCheckpoint()
    points = spark.createDataFrame([("TA", "2024-06-30"), ("TB", "2025-03-31")], "ticker string, as_of string").withColumn("as_of", F.to_date("as_of"))
    early, late = insider.fold_trades(trades), insider.fold_trades(trades, by_owner=True)
    assert sorted(map(str, early.collect())) == sorted(map(str, late.select(early.columns).collect()))
    text = insider.insider_activity(trades, F.broadcast(points))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x and "owner" in x for x in text.splitlines()) == 1


def test_lists_move_named_columns_once(spark):
    """F5 to F10: a column that a list names several times stands once in the moved rows."""
    from tidemark.operators.digests import list_digests

    rows = spark.createDataFrame([("k", "b", "x"), ("k", "a", None)], "k string, a string, t string")
    out = list_digests(rows, ["k"], "a", ["a", "t"], distinct=False, texts={"s": "a", "u": "t", "v": lambda c: F.nullif(c, F.lit("b"))})
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in out.collect()] == [(2, "a;b", "x", "a")]
    moved = next(x for x in plan(out).splitlines() if "Repartition" in x)
    below = plan(out).split(moved, 1)[1].splitlines()[1]
    assert below.count("_c_") == 2 and "_t2" not in below


def test_newest_moves_are_made_once(spark, monkeypatch):
    """the alerts of the newest filings read written moves and filing totals."""
    from tidemark.operators import holdings
    from tidemark.plans import delivery_queries
    from tidemark.plans.driver_tables import Tables

    real, made = holdings.filing_totals, []
    monkeypatch.setattr(holdings, "filing_totals", lambda p: made.append(1) or real(p))
    text = plan(delivery_queries._messages(Tables(spark, SF)))
    assert len(made) == 1 and "Window [sum" not in text and "Generate" not in text


def test_form4_report_reads_rows_once(spark):
    """one fold by key gives the whole report, also with bad rows, bad copies and tickers that have bad rows only."""
    names = "ticker, issuer_cik, issuer_name, accession, filing_date, transaction_date, owner_cik, transaction_code, acquired_disposed, shares, price_per_share"
    row = lambda t, acc="x", cik="1", name="I", px="2": (t, cik, name, acc, "2024-02-03", "2024-02-01", "9", "P", "A", "5", px)
    rows = spark.createDataFrame([row("a"), row("A"), row("a"), row("a", name=""), row("a", "y", cik="2"), row("b", px="z"), row("q"), row("")],
                                 ", ".join(f"{n} string" for n in names.split(", ")))
    universe = spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "ticker string")
    out = insider.validate_form4(rows, universe)
    got = out.first().asDict()
    want = {"rows_total": 8, "invalid_rows": 4, "unexpected_tickers": 1, "rows_valid": 3, "duplicate_rows": 1, "tickers_observed": 1,
            "open_market_buy_rows": 3, "mixed_issuer_tickers": 1, "issuer_name_variants": 0, "ticker_universe_count": 3, "tickers_empty": 2}
    assert {k: got[k] for k in want} == want
    assert insider.validate_form4(rows.limit(0), universe).first()["tickers_empty"] == 3
    assert plan(out).count("LogicalRDD") == 3  # rows, and the universe as filter and as list


def test_flawed_moves_of_funds_dealt_out_once(spark):
    """F16: flawed lines move while they are narrow, once by fund, and give the same moves and the same stored positions."""
    from tidemark.plans.driver_tables import Tables

    t = Tables(spark, SF)
    flat = lambda df: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.collect())
    dealt, want = t.moves(flawed=True, by_fund=True), t.moves(flawed=True)
    assert flat(dealt.select("cik", "report_date", "cusip", "put_call", "ticker", "move", "curr_value", "prev_value", "curr_weight", "accession")) == flat(
        want.select("cik", "report_date", "cusip", "put_call", "ticker", "move", "curr_value", "prev_value", "curr_weight", "accession"))
    text = t.positions(t.flawed_lines(by_fund=True))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x and "cik" in x for x in text.splitlines()) == 1
    assert flat(t.holdings(True)) == flat(t.positions(t.flawed_lines()))


def test_flow_reads_moves_once(spark):
    """F16: summary, weights and kinds of moves of a ticker come from one pass; weights of exits don't count."""
    from tidemark.operators import watch

    row = lambda cik, move, w, t="A": ("2024-03-31", t, cik, "", move, 1.0, w)
    m = spark.createDataFrame([row("1", "NEW", 0.2), row("1", "TRIM", 0.4), row("2", "EXIT", 9.0), row("2", "HOLD", None), row("3", "EXIT", 0.5, "B")],
                              "report_date string, ticker string, cik string, put_call string, move string, curr_value double, curr_weight double")
    flow = watch.ticker_flow(m)
    got = {r.ticker: (round(r.avg_weight, 9) if r.avg_weight is not None else None, r.movement_codes, r.holder_count, r.exits) for r in flow.collect()}
    assert got == {"A": (0.3, ["EXIT", "HOLD", "NEW", "TRIM"], 2, 1), "B": (None, ["EXIT"], 0, 1)}
    assert plan(flow).count("LogicalRDD") == 1


def test_moves_by_neighbours_agree_and_sort_less(spark):
    """F18, F20 (shared by F6 to F9): moves looked up beside a security's quarters are those of the fold, also with texts that are
    missing once, securities that skip a stored quarter or come back, and first and last quarters; positions are sorted once."""
    from tidemark.operators import holdings
    from tidemark.operators.moves import fund_moves, quarter_moves

    line = lambda cik, day, cusip, shares, put="", ticker="T": (
        f"{cik}{day}", cik, day, "A", day, cusip, put, shares * 2.0, shares, f"I{day}" if shares else None, "COM", ticker)
    rows = [line("1", "2024-03-31", c, 5.0) for c in "abcd"] + [line("1", "2024-06-30", c, s) for c, s in (("a", 5.0), ("b", 9.0), ("e", 1.0))]
    rows += [line("1", "2024-12-31", c, s) for c, s in (("a", 1.0), ("c", 4.0), ("b", 0.0))] + [line("1", "2024-06-30", "a", 3.0, "Put")]
    rows += [line("2", "2024-06-30", "a", 7.0, ticker=None), line("2", "2024-09-30", "a", 8.0), line("2", "2024-12-31", "a", 8.0, ticker=None)]
    lines = spark.createDataFrame(rows, "accession string, cik string, report_date string, form string, filing_date string, cusip string, put_call string, "
                                  "value double, shares double, issuer string, title_of_class string, ticker string").withColumns(
        {c: F.to_date(c) for c in ("report_date", "filing_date")})
    want = quarter_moves(holdings.fund_snapshots(holdings.build_positions(lines)))
    got = fund_moves(holdings.fund_snapshots(holdings.build_positions(lines.repartition("cik"), ordered=True)))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and {r.move for r in got.collect()} == {"NEW", "ADD", "TRIM", "HOLD", "EXIT"}
    assert text.count("Exchange") == 1 and sum(" Sort [" in x for x in text.splitlines()) == 2


def test_trades_of_an_owner_are_summed_once(spark):
    """F18, F20 (shared by F6 to F9): trades are not folded by day before they are summed by owner, and what nobody reads does not move."""
    from tidemark.plans.driver_tables import Tables

    trades = Tables(spark, SF).trades().localCheckpoint()
    trades = trades.unionByName(trades.filter("shares > 40"))  # several trades of one owner and day
    points = spark.createDataFrame([("TAA", "2024-06-30"), ("TAB", "2024-07-31"), ("TAB", "2024-08-31")], "ticker string, as_of string").withColumn("as_of", F.to_date("as_of"))
    points = points.unionByName(trades.groupBy("ticker").agg(F.max("filing_date").alias("as_of")))
    flat = lambda df: sorted(str(tuple(round(x, 4) if isinstance(x, float) else x for x in r)) for r in df.collect())
    got = insider.insider_activity(trades, F.broadcast(points))
    want = insider.ticker_activity(insider.owner_activity(insider.visible_at(insider.fold_trades(trades), points)))
    assert flat(got.select(want.columns)) == flat(want) and got.count() > 20
    text = got.select("ticker", "as_of", "n_buyers", "n_c_suite_buyers", "units" if "units" in got.columns else "conviction_units")._jdf.queryExecution().executedPlan().toString()
    above = text[:next(text.index(x) for x in text.splitlines() if "Exchange hashpartitioning" in x and "owner" in x)]
    assert above.count("SortAggregate(") <= 2 and "sell_shares" not in text and "first_sell" not in text


def test_flags_of_signals_are_plain_tests(spark):
    """F18, F20 (shared by F6 to F9): flags are tests in the plan, no lists walked for each move; they are the flags of a line."""
    from tidemark.functions import texts
    from tidemark.plans import features as feat

    row = lambda t, title: ("2024-03-31", t, title, "1", "c", "I", "", "NEW", 1.0, 0.1, "2024-05-01")
    moves = spark.createDataFrame([row(t, x) for t in ("AAA", "  ", "ABCD-USD", "x1", "B B") for x in ("COM", "PFD NOTE", None)],
                                  "report_date string, ticker string, title_of_class string, cik string, cusip string, issuer string, put_call string, move string, "
                                  "curr_value double, curr_weight double, filing_date string")
    flags = moves.withColumn("ticker", F.upper("ticker")).withColumn("f", texts.ticker_flags("ticker", "title_of_class"))
    kept, whole = feat.institutional_signals(moves), feat.institutional_signals(moves, include_non_priceable=True)
    assert {r.ticker: r.n_moves for r in kept.collect()} == {r.ticker: r.n for r in flags.filter("size(f) = 0").groupBy("ticker").agg(F.count("*").alias("n")).collect()}
    want = flags.groupBy("ticker").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_remove("f", "missing_ticker"))))).alias("f"))
    assert {r.ticker: r.quality_flags for r in whole.collect()} == {r.ticker: r.f for r in want.collect()}
    assert "lambdafunction" not in plan(kept) and all(r.quality_flags == [] for r in kept.collect())
