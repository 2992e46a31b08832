"""The domain tables, derived from the driver's parquet tables.

Every rule maps whole tables; no row of lineitem, orders, customer or events is left out.
Column pruning and filters reach the parquet scans because everything is plain
DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import holdings
from tidemark.operators.moves import fund_moves, quarter_moves
from tidemark.session import materialize

YEARS = 26  # shift that puts trade dates on both sides of the reporting-unit change
NOW = "2024-01-20 12:00:00"  # "now" of the event-based reports


def day(c: str | Column, years: int = YEARS) -> Column:
    return F.add_months(F.to_date(c), 12 * years)


def quarter_end(c: str | Column) -> Column:
    return F.add_months(F.last_day(F.add_months(F.trunc(F.to_date(c), "quarter"), 2)), 12 * YEARS)


def brand_no(c: str = "p_brand") -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1)


def ticker_of(no: Column) -> Column:
    return F.concat(F.lit("T"), F.translate(no, "0123456789", "ABCDEFGHIJ"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def line_parts(self) -> DataFrame:
        """Order lines with their parts: the written table where one was kept."""
        if "line_parts" in self._stored:
            return self._stored["line_parts"]
        l, p = self.read("lineitem"), self.read("part").withColumn("brand_no", brand_no())
        return l.join(p, l["l_partkey"] == p["p_partkey"])

    def keep_line_parts(self) -> None:
        """Lines meet their parts once for holdings, prices and trades, with the columns these read."""
        self._store("line_parts", lambda: self.line_parts().select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
            "p_brand", "brand_no", "p_name", "p_type", "p_size"))

    # -- filings ---------------------------------------------------------------
    def lines(self, by_fund: bool = False) -> DataFrame:
        """Reported lines. A third of the funds put most amendment lines into the original
        filing, so their amendments are partial. ``by_fund`` deals the lines out by fund while they
        are narrow: texts are made of them afterwards."""
        amended = (F.col("l_linestatus") == "O") & ~(
            (F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") > 2)
        )
        rows = self.line_parts().select(
            F.lpad(F.col("l_suppkey").cast("string"), 10, "0").alias("cik"), quarter_end("l_shipdate").alias("report_date"),
            amended.alias("amended"), (F.col("l_returnflag") == "R").alias("put"), "brand_no", "p_name", "p_type", "l_extendedprice", "l_quantity")
        if by_fund:
            rows = rows.repartition("cik")
        no = F.col("brand_no")
        return self._filed(
            rows.select(
                "cik", "report_date",
                F.when(F.col("amended"), "13F-HR/A").otherwise("13F-HR").alias("form"),
                F.concat(F.lit("BR"), F.lpad(no, 4, "0"), F.lit("100")).alias("cusip"),
                F.when(no.cast("int") % 8 != 5, ticker_of(no)).alias("ticker"),
                F.col("p_name").alias("issuer"),
                F.col("p_type").alias("title_of_class"),
                F.when(F.col("put"), "Put").otherwise("").alias("put_call"),
                F.col("l_extendedprice").alias("value"),
                F.col("l_quantity").alias("shares"),
            )
        )

    @staticmethod
    def _filed(lines: DataFrame) -> DataFrame:
        """Accession and filing date from fund, quarter and form."""
        wait = F.when(F.col("form") == "13F-HR", 45).otherwise(75)
        return lines.withColumns(
            {
                "accession": F.concat_ws("|", "cik", F.col("report_date").cast("string"), "form"),
                "filing_date": F.date_add("report_date", wait),
            }
        )

    def flawed_lines(self, by_fund: bool = False) -> DataFrame:
        """The same lines with reporting errors, quarters skipped and late funds, for the
        quality checks. Values and dates are changed; lines are not removed and stay with their fund."""
        base = self.lines(by_fund).drop("accession", "filing_date")
        fund = F.col("cik").cast("long")
        at = lambda d: F.col("report_date") == F.lit(d).cast("date")
        last, before = "2027-12-31", "2027-09-30"
        factor = (
            F.when(at(before) & (fund % 10 == 1), 1000.0)
            .when(at("2025-06-30") & (fund % 10 == 2), 0.001)
            .when(at(last) & (fund % 10 == 3), 300.0)
            .when(at(last) & (fund % 10 == 5), 0.0005)
            .otherwise(1.0)
        )
        quarter = (
            F.when(at(last) & (fund % 9 == 4), F.lit(before).cast("date"))
            .when((F.month("report_date") == 6) & (fund % 7 == 0), F.last_day(F.add_months("report_date", -3)))
            .otherwise(F.col("report_date"))
        )
        thin = at(last) & (fund % 11 == 7)
        no = F.substring("cusip", 3, 4).cast("int")
        changed = base.select(
            "cik",
            quarter.alias("report_date"),
            F.when(thin, "13F-HR/A").otherwise(F.col("form")).alias("form"),
            F.when(thin, F.concat(F.lit("BR000"), (no % 3).cast("string"), F.lit("100"))).otherwise(F.col("cusip")).alias("cusip"),
            "ticker", "issuer", "title_of_class",
            F.when(thin, "").otherwise(F.col("put_call")).alias("put_call"),
            (F.col("value") * factor).alias("value"),
            "shares",
        )
        return self._filed(changed)

    def positions(self, lines: DataFrame | None = None) -> DataFrame:
        return holdings.build_positions(self.lines() if lines is None else lines)

    def filings(self, lines: DataFrame | None = None) -> DataFrame:
        return holdings.filing_totals(self.positions(lines))

    def resolved(self, lines: DataFrame | None = None) -> DataFrame:
        return holdings.resolve_filings(self.filings(lines))

    def holdings(self, flawed: bool = False) -> DataFrame:
        """The positions as a written table: several steps read them, and the lines are
        scanned and shuffled once."""
        return self._store("flawed" if flawed else "plain",
                           lambda: self.positions(self.flawed_lines(by_fund=True) if flawed else self.lines(by_fund=True)))

    def totals(self) -> DataFrame:
        """The filings of the stored positions, written once (filing rows only)."""
        return self._store("totals", lambda: holdings.filing_totals(self.holdings()))

    def _store(self, name: str, make) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = materialize(make(), name)
        return self._stored[name]

    def chain(self, flawed: bool = False) -> DataFrame:
        """Resolved filings with their neighbours in time, written once (filing rows only)."""
        return self._store(
            "flawed_chain" if flawed else "chain",
            lambda: holdings.quarter_chain(holdings.resolve_filings(
                holdings.filing_totals(self.holdings(True)) if flawed else self.totals())),
        )

    def snapshots(self, weights: bool = True, flawed: bool = False) -> DataFrame:
        """Resolved positions with the fund's next and previous quarter."""
        positions, chain = self.holdings(flawed), self.chain(flawed)
        if not weights:
            return holdings.snapshot(positions, chain)
        snap = holdings.snapshot(positions, chain, "total_value")
        return snap.withColumn(
            "weight", F.when(F.col("total_value") > 0, F.col("value_usd") / F.col("total_value")).otherwise(0.0)
        ).drop("total_value")

    def moves(self, weights: bool = True, flawed: bool = False, by_fund: bool = False) -> DataFrame:
        """``by_fund``: the same moves from lines that are dealt out once, by fund; nothing moves after that."""
        if by_fund:
            stored, lines = self._stored.get("flawed" if flawed else "plain"), self.flawed_lines if flawed else self.lines
            dealt = holdings.build_positions(lines(by_fund=True), ordered=True) if stored is None else stored.repartition("cik")
            return fund_moves(holdings.fund_snapshots(dealt))
        return quarter_moves(self.snapshots(weights, flawed))

    def funds(self) -> DataFrame:
        return self.read("supplier").select(
            F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"),
            F.col("s_name").alias("label"),
            F.lit(None).cast("string").alias("manager"),
        )

    def flawed_funds(self) -> DataFrame:
        """Suppliers, some with a shared label, and nations as funds that never filed."""
        s = self.read("supplier")
        shared = F.concat(
            F.when(F.col("s_suppkey") % 2 == 0, F.lit("Fund  ")).otherwise(F.lit("fund ")),
            F.col("s_nationkey").cast("string"),
        )
        filers = s.select(
            F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"),
            F.when(F.col("s_suppkey") % 13 == 5, shared).otherwise(F.col("s_name")).alias("label"),
        )
        silent = self.read("nation").select(
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("cik"),
            F.col("n_name").alias("label"),
        )
        return filers.unionByName(silent)

    # -- prices and insider trades --------------------------------------------
    def prices(self) -> DataFrame:
        """Daily prices in whole cents (the tiny addend keeps half cents from rounding either way)."""
        return (
            self.line_parts()
            .groupBy(ticker_of(F.col("brand_no")).alias("ticker"), day("l_shipdate").alias("date"))
            .agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-7, 2).alias("adj_close"))
        )

    def stored_prices(self) -> DataFrame:
        """The prices as a written table, a row per ticker and day: lines are scanned once for all that look them up."""
        return self._store("prices", self.prices)

    def fundamentals(self) -> DataFrame:
        p = self.read("part")
        return p.groupBy(ticker_of(brand_no()).alias("ticker")).agg(
            F.sum("p_retailprice").alias("market_cap"),
            F.sum("p_size").cast("double").alias("shares_outstanding"),
        )

    def trades(self) -> DataFrame:
        """Insider trades: one per order line, the customer as owner."""
        l, o, c = self.line_parts(), self.read("orders"), self.read("customer")
        traded = (F.col("l_returnflag") == "R")
        code = (
            F.when((F.col("o_orderstatus") == "F") & traded, "P")
            .when((F.col("o_orderstatus") == "O") & traded, "S")
            .when(F.col("o_orderstatus") == "P", "M")
            .otherwise("A")
        )
        seg = F.col("c_mktsegment")
        title = (
            F.when(seg == "BUILDING", "Chief Executive Officer")
            .when(seg == "MACHINERY", "CFO")
            .when(seg == "HOUSEHOLD", "Secretary")
            .otherwise("")
        )
        no = F.col("brand_no")
        # Orders meet their customers before the lines, which are many more, so lines move once less.
        placed = o.join(c, o["o_custkey"] == c["c_custkey"])
        return (
            l.join(placed, l["l_orderkey"] == o["o_orderkey"])
            .select(
                ticker_of(no).alias("ticker"),
                F.lpad(no, 10, "0").alias("issuer_cik"),
                F.col("p_brand").alias("issuer_name"),
                F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("accession"),
                F.date_add(day("l_shipdate"), 2).alias("filing_date"),
                day("l_shipdate").alias("transaction_date"),
                F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("owner_cik"),
                F.col("c_name").alias("owner_name"),
                title.alias("officer_title"),
                (title != "").alias("is_officer"),
                (seg == "AUTOMOBILE").alias("is_director"),
                (seg == "FURNITURE").alias("is_ten_percent_owner"),
                code.alias("transaction_code"),
                F.when(code == "S", "D").otherwise("A").alias("acquired_disposed"),
                F.lit("Common Stock").alias("security_title"),
                F.col("l_quantity").alias("shares"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_share"),
                (F.col("l_quantity") * (1 + F.col("p_size") / 10.0)).alias("shares_owned_after"),
            )
        )

    # -- events ----------------------------------------------------------------
    def event_rows(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        status = F.when(k < 5, 500).when(k < 10, 429).when(k < 20, 403).when(k < 30, 401).otherwise(200)
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.lpad(F.col("user_id").cast("string"), 6, "0").alias("key_id"),
            F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
            F.concat(F.lit("/api/"), F.col("event_type")).alias("route"),
            F.col("event_type").alias("tool"),
            status.alias("status"),
            F.col("ts").cast("timestamp").alias("at"),
            F.col("value").alias("duration_ms"),
            k.alias("k"),
        )

    def audit(self) -> DataFrame:
        return self.event_rows().select("id", "key_id", "method", "route", "status", "at")

    def telemetry(self) -> DataFrame:
        """Tool calls, with http and rpc rows for some event types."""
        e = self.event_rows()
        clients = F.array(F.lit("codex-cli"), F.lit("ChatGPT"), F.lit("cursor 1.2"), F.lit("VS Code; vscode"),
                          F.lit("my cline bot"), F.lit("mcp-inspector"), F.lit("something else"))
        kind = F.when(F.col("tool") == "signup", "initialize").when(F.col("tool") == "error", "http").otherwise("tool")
        return e.select(
            F.col("at").alias("ts"), kind.alias("kind"), "status", "tool",
            F.element_at(clients, (F.col("k") % 7 + 1).cast("int")).alias("client"),
            (F.col("status") == 200).alias("success"),
            (F.col("duration_ms") * 300).alias("duration_ms"),
        )

    def api_keys(self) -> DataFrame:
        """One key per event user, with limits and dates that depend on the user."""
        first = self.read("events").groupBy("user_id").agg(
            F.min("ts").cast("timestamp").alias("first_ts"), F.max("ts").cast("timestamp").alias("last_used_at")
        )
        u = F.col("user_id")
        days = lambda n: F.to_timestamp(F.lit(NOW)) + F.make_interval(days=n.cast("int"))
        null = F.lit(None).cast("timestamp")
        return first.select(
            F.lpad(u.cast("string"), 6, "0").alias("key_id"),
            F.concat(F.lit("Key "), u.cast("string")).alias("label"),
            F.when(u % 9 == 0, "admin:read read").otherwise("read").alias("scopes"),
            F.when(u % 2 == 0, "pro").otherwise("team").alias("tier"),
            (u % 4 + 1).cast("long").alias("rate_per_min"),
            F.when(u % 10 == 7, 0).otherwise(u % 6 + 2).cast("long").alias("rate_per_day"),
            F.col("first_ts").alias("created_at"),
            F.when(u % 5 == 1, days(u % 30 - 10)).otherwise(null).alias("expires_at"),
            F.when(u % 3 == 1, days(u % 40 - 15)).otherwise(null).alias("rotation_due_at"),
            F.when(u % 11 == 3, F.col("last_used_at")).otherwise(null).alias("revoked_at"),
            "last_used_at",
        )

    def watchlists(self) -> DataFrame:
        """A watchlist per customer: three tickers, a schedule and filters."""
        c = self.read("customer")
        k = F.col("c_custkey")
        tick = lambda i: ticker_of(((k + i) % 25 + 1).cast("string"))
        seg = F.col("c_mktsegment")
        frequency = F.when(seg.isin("BUILDING", "MACHINERY"), "daily").when(
            seg.isin("HOUSEHOLD", "AUTOMOBILE"), "weekly").otherwise("manual")
        now = F.to_timestamp(F.lit(NOW))
        return c.select(
            F.concat(F.lit("w"), F.lpad(k.cast("string"), 8, "0")).alias("watchlist_id"),
            F.lpad((k % 150).cast("string"), 6, "0").alias("key_id"),
            F.col("c_name").alias("name"),
            F.array(tick(0), tick(7), tick(13)).alias("tickers"),
            (k % 4 != 3).alias("enabled"),
            frequency.alias("frequency"),
            F.when(k % 3 == 0, F.array(F.lit("alert"), F.lit("watch"))).alias("actions"),
            F.when(k % 5 == 0, F.array(F.lit("NEW"))).alias("moves"),
            F.when(k % 2 == 0, F.lit(40.0)).alias("min_score"),
            F.when(k % 7 == 0, F.lit(2)).alias("min_holders"),
            F.when(k % 6 == 0, F.lit(1)).alias("min_buyers"),
            F.when(k % 8 == 0, F.lit(5e6)).alias("max_13f_value_usd"),
            (now - F.make_interval(hours=(k % 500).cast("int"))).alias("created_at"),
            (now - F.make_interval(hours=(k % 97).cast("int"))).alias("updated_at"),
        )

    def watch_snapshots(self) -> DataFrame:
        """Earlier snapshots of watchlists: one per order of the customer."""
        o = self.read("orders")
        now = F.to_timestamp(F.lit(NOW))
        return o.select(
            F.concat(F.lit("s"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("snapshot_id"),
            F.concat(F.lit("w"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("watchlist_id"),
            F.lpad((F.col("o_custkey") % 150).cast("string"), 6, "0").alias("key_id"),
            (now - F.make_interval(hours=(F.col("o_orderkey") % 900 + 1).cast("int"))).alias("created_at"),
        )

    def workspace_alerts(self) -> DataFrame:
        """Open, acknowledged and dismissed alerts: one per order."""
        o = self.read("orders")
        k = F.col("o_orderkey")
        now = F.to_timestamp(F.lit(NOW))
        return o.select(
            F.concat(F.lit("a"), F.lpad(k.cast("string"), 9, "0")).alias("alert_id"),
            F.lpad((F.col("o_custkey") % 150).cast("string"), 6, "0").alias("key_id"),
            F.concat(F.lit("w"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("watchlist_id"),
            ticker_of((k % 25 + 1).cast("string")).alias("ticker"),
            F.when(k % 3 == 0, "alert").otherwise("watch").alias("action"),
            F.when(k % 3 == 0, 3).otherwise(2).cast("long").alias("severity"),
            F.when(F.col("o_orderstatus") == "O", "open").when(
                F.col("o_orderstatus") == "F", "acknowledged").otherwise("dismissed").alias("status"),
            (now - F.make_interval(hours=(k % 700 + 24).cast("int"))).alias("first_seen_at"),
            (now - F.make_interval(hours=(k % 24).cast("int"))).alias("last_seen_at"),
        )
