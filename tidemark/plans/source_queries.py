"""Registered queries on documents, reference files and column functions.

Documents are written by Spark from the driver's tables and parsed back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import texts, values
from tidemark.operators import insider, resolve
from tidemark.plans.driver_tables import Tables, brand_no, day, ticker_of
from tidemark.session import materialize, shared_folder
from tidemark.sources import documents, market, registry, tables, writers
from tidemark.plans.filing_queries import money

DOCTYPE = '<!DOCTYPE x [<!ENTITY a "b">]>'


def tag(name: str, *body, prefix=None):
    if prefix is None:
        return F.concat(F.lit(f"<{name}>"), *body, F.lit(f"</{name}>"))
    p = prefix
    return F.concat(F.lit("<"), p, F.lit(f"{name}>"), *body, F.lit("</"), p, F.lit(f"{name}>"))


def wrapped(name: str, value):
    return tag(name, tag("value", value))


def _line_parts(t: Tables) -> DataFrame:
    l, p = t.read("lineitem"), t.read("part")
    return l.join(p, l["l_partkey"] == p["p_partkey"])


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out evenly before documents are made of them: a document is many times as long as its row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def info_table_docs(t: Tables, spoil: bool = False) -> DataFrame:
    """One holdings document per order line: the line, and a second entry with bad numbers."""
    ns = F.when(F.col("l_linestatus") == "F", "ns1:").otherwise("")
    el = lambda name, *body: tag(name, *body, prefix=ns)
    kind = F.when(F.col("l_linenumber") % 2 == 1, el("sshPrnamtType", F.lit("PRN"))).otherwise("")
    first = el("infoTable", el("nameOfIssuer", F.col("p_name")), el("titleOfClass", F.col("p_type")),
               el("cusip", F.lower("p_brand")), el("value", F.format_number("l_extendedprice", 2)),
               el("shrsOrPrnAmt", el("sshPrnamt", F.col("l_quantity").cast("string")), kind),
               F.when(F.col("l_returnflag") == "R", el("putCall", F.lit("Put"))).otherwise(""))
    second = el("infoTable", el("nameOfIssuer", F.lit(" Spare ")), el("cusip", F.lit("")), el("value", F.lit("n/a")))
    root = F.concat(F.lit("<"), ns, F.lit('informationTable xmlns:ns1="urn:holdings">'), first, second,
                    F.lit("</"), ns, F.lit("informationTable>"))
    n = F.col("l_linenumber")
    if spoil:
        root = (F.when(n == 1, F.concat(F.lit(DOCTYPE), root)).when(n == 2, F.substring(root, 1, 150))
                .when(n == 3, "").when(n == 4, "<ns1:informationTable xmlns:ns1='urn:holdings'></ns1:informationTable>").otherwise(root))
    rows = _dealt(_line_parts(t).select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity", "p_name", "p_type", "p_brand"),
        "l_orderkey", "l_linenumber")
    return rows.select(F.col("l_orderkey").cast("string").alias("accession"), "l_returnflag", root.alias("xml"))


def s1_info_table_xml(spark, sf):
    rows = documents.parse_info_tables(info_table_docs(Tables(spark, sf)), dealt=True)
    return rows.groupBy("issuer", "title_of_class", "cusip", "sh_prn_type", "put_call").agg(
        F.count(F.lit(1)).alias("n"), money2("value"), F.sum("shares").alias("shares"))


def money2(c):
    return F.round(F.sum(c), 2).alias(c)


def s2_quarantined_documents(spark, sf):
    out = documents.rejected(info_table_docs(Tables(spark, sf), spoil=True), dealt=True)
    return out.groupBy("reject", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def s4_malformed_skipped(spark, sf):
    """The lines of all other documents are read although some documents are broken."""
    rows = documents.parse_info_tables(info_table_docs(Tables(spark, sf), spoil=True), dealt=True)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), money2("value"))


def form4_docs(t: Tables) -> DataFrame:
    """One ownership document per insider trade; some name another issuer."""
    flag = lambda c: F.when(F.col(c), "1").otherwise("false")
    other = F.col("accession").endswith("|7")
    xml = tag(
        "ownershipDocument",
        tag("periodOfReport", F.col("transaction_date").cast("string")),
        tag("issuer", tag("issuerCik", F.when(other, "999").otherwise(F.ltrim(F.col("issuer_cik"), F.lit("0")))),
            tag("issuerName", F.col("issuer_name")), tag("issuerTradingSymbol", F.lower("ticker"))),
        tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerCik", F.col("owner_cik")), tag("rptOwnerName", F.col("owner_name"))),
            tag("reportingOwnerRelationship", tag("isDirector", flag("is_director")), tag("isOfficer", flag("is_officer")),
                tag("isTenPercentOwner", flag("is_ten_percent_owner")), tag("officerTitle", F.col("officer_title")))),
        tag("nonDerivativeTable", tag(
            "nonDerivativeTransaction", wrapped("securityTitle", F.col("security_title")),
            wrapped("transactionDate", F.col("transaction_date").cast("string")),
            tag("transactionCoding", tag("transactionFormType", F.lit("4")), tag("transactionCode", F.lower("transaction_code"))),
            tag("transactionAmounts", wrapped("transactionShares", F.col("shares").cast("string")),
                wrapped("transactionPricePerShare", F.col("price_per_share").cast("string")),
                F.when(F.col("acquired_disposed") == "D", wrapped("transactionAcquiredDisposedCode", F.lit("D"))).otherwise("")),
            tag("postTransactionAmounts", wrapped("sharesOwnedFollowingTransaction", F.col("shares_owned_after").cast("string"))),
            tag("ownershipNature", wrapped("directOrIndirectOwnership", F.when(F.col("is_director"), "I").otherwise("D"))))),
    )
    filed = F.when(F.col("is_officer"), F.col("filing_date").cast("string")).otherwise("")
    return _dealt(t.trades(), "accession").select("accession", filed.alias("filing_date"), xml.alias("xml"))


S3_COLUMNS = ("issuer_ticker", "issuer_cik", "transaction_code", "acquired_disposed", "officer_title", "is_officer", "is_director",
              "is_ten_percent_owner", "direct", "shares", "price_per_share", "shares_owned_after", "filing_date", "transaction_date")


def s3_form4_xml(spark, sf):
    r = documents.parse_form4(form4_docs(Tables(spark, sf)), columns=S3_COLUMNS, dealt=True)
    return r.groupBy("issuer_ticker", "issuer_cik", "transaction_code", "acquired_disposed", "officer_title", "is_officer",
                     "is_director", "is_ten_percent_owner", "direct").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.round(F.sum("price_per_share"), 2).alias("prices"),
        F.round(F.sum("shares_owned_after"), 2).alias("owned"), F.min("filing_date").alias("first_filed"),
        F.max("transaction_date").alias("last_traded"))


def _form4_build(t: Tables, *columns: str):
    """Parsed trades with the columns that are read, and the tickers asked for with their ciks: these are few and
    written first, so that joins with them move no trades."""
    wanted = {"issuer_ticker", "issuer_cik", *columns}
    parsed = documents.parse_form4(form4_docs(t), columns=wanted, dealt=True).withColumn("ticker", F.col("issuer_ticker"))
    universe = _line_parts(t).select(ticker_of(brand_no()).alias("ticker")).distinct().unionByName(
        t.spark.createDataFrame([("QQQ",)], "ticker string"))
    ciks = materialize(resolve.ticker_cik_map(_companies(t)), "ciks")
    return parsed, materialize(universe, "universe"), ciks, F.lit("2023-01-01").cast("date"), F.lit("2025-12-31").cast("date")


def k8_form4_rows(spark, sf):
    rows = insider.build_form4_rows(*_form4_build(Tables(spark, sf), "filing_date", "transaction_date", "transaction_code", "shares", "price_per_share"))
    return rows.groupBy("ticker", "transaction_code").agg(F.count(F.lit(1)).alias("n"), money2("value_usd"))


def k8_form4_summary(spark, sf):
    return insider.form4_build_summary(*_form4_build(Tables(spark, sf), "filing_date", "transaction_date", "issuer_name", "owner_cik"))


def p13_issuer_guard(spark, sf):
    parsed, universe, ciks, *_ = _form4_build(Tables(spark, sf), "issuer_name", "owner_cik")
    _, dropped = insider.guard_issuers(parsed, universe.join(ciks, "ticker"))
    return dropped.groupBy("ticker", "expected_issuer_cik", "actual_issuer_cik").agg(F.count(F.lit(1)).alias("n"))


def j11_ticker_cik_misses(spark, sf):
    """Tickers of the universe without a cik."""
    t = Tables(spark, sf)
    _, universe, ciks, *_ = _form4_build(t)
    return universe.join(ciks, "ticker", "left_anti")


# -- filing lists: one submissions document per order -----------------------------
def _orders(t: Tables) -> DataFrame:
    """The lines of each order as a sorted array (an order has a handful of lines)."""
    line = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    return t.read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))


def submission_docs(t: Tables) -> DataFrame:
    form = lambda l: (F.when(l["l_linenumber"] == 1, "13F-HR").when(l["l_linenumber"] == 2, "13F-HR/A").when(l["l_linenumber"] == 3, "4")
                      .when(l["l_linenumber"] == 4, "4/A").when(l["l_linenumber"] == 5, "4").otherwise("10-K"))
    each = lambda f: F.transform("x", f)
    recent = F.struct(
        each(form).alias("form"),
        each(lambda l: F.concat_ws("-", l["l_partkey"].cast("string"), l["l_suppkey"].cast("string"))).alias("accessionNumber"),
        each(lambda l: F.to_date(l["l_shipdate"]).cast("string")).alias("filingDate"),
        each(lambda l: F.last_day(l["l_shipdate"]).cast("string")).alias("reportDate"),
        # The last entry has no document name.
        F.slice(each(lambda l: F.concat(F.lit("d"), l["l_quantity"].cast("int").cast("string"))), F.lit(1), F.size("x") - 1).alias("primaryDocument"),
    )
    return _orders(t).select(
        F.col("l_orderkey").alias("owner"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))


def s5_filing_index(spark, sf):
    out = documents.list_13f_filings(submission_docs(Tables(spark, sf)))
    return out.select("owner", "form", "accession", "filing_date", "report_date", "primary_doc")


def s5_originals_only(spark, sf):
    out = documents.list_13f_filings(submission_docs(Tables(spark, sf)), include_amendments=False)
    return out.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.max("filing_date").alias("newest"))


def s6_form4_index(spark, sf):
    out = documents.list_form4_filings(submission_docs(Tables(spark, sf)), since="1997-01-01", limit=2)
    return out.select("owner", "form", "accession", "filing_date")


def _package(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("accession"), F.concat_ws("-", n.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string")).alias("pos"),
        F.when(n == 1, "primary_doc.xml").when(n == 2, "cover.txt").when(n == 3, "doc-index.xml").when(n == 4, "style.xsl")
        .otherwise(F.concat(F.lit("Table"), F.col("l_partkey").cast("string"), F.lit(".XML"))).alias("name"),
        F.when(F.col("l_linestatus") == "F", "4").otherwise("EX").alias("type"),
        F.when(F.col("l_returnflag") != "N", "<infoTable>").otherwise("<other>").alias("content"),
    )


def s7_pick_info_table(spark, sf):
    return documents.pick_info_table(_package(Tables(spark, sf)))


def s8_pick_ownership(spark, sf):
    return documents.pick_ownership(_package(Tables(spark, sf)))


# -- reference files -----------------------------------------------------------------
def _companies(t: Tables) -> DataFrame:
    no = brand_no()
    suffix = F.element_at(F.array(*[F.lit(s) for s in (" Inc.", " Corp", ", The", " Holdings plc", " A/S", "")]), (F.col("p_size") % 6 + 1).cast("int"))
    return t.read("part").select(
        F.concat("p_name", suffix).alias("title"), F.lower(ticker_of(no)).alias("ticker"),
        no.cast("long").alias("cik_str"), F.col("p_partkey").alias("file_order"))


def s9_name_index(spark, sf):
    return resolve.name_index(_companies(Tables(spark, sf)))


def s10_ticker_cik_map(spark, sf):
    return resolve.ticker_cik_map(_companies(Tables(spark, sf)))


def _candidates(t: Tables) -> DataFrame:
    no = brand_no()
    return t.read("part").select(
        F.concat(F.lit("br"), F.lpad(no, 4, "0"), F.lpad((F.col("p_partkey") % 40).cast("string"), 3, "0")).alias("cusip"),
        F.when(F.col("p_size") % 3 == 0, 2).otherwise(1).alias("pass_no"),
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_type").isin("SMALL", "LARGE"), "Equity").otherwise("Corp").alias("market_sector"),
        F.when(F.col("p_size") % 2 == 0, "Common Stock").otherwise("REIT").alias("security_type"),
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("BBG"), F.col("p_partkey").cast("string"))).alias("composite_figi"),
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("figi"),
    )


def s11_select_instrument(spark, sf):
    return resolve.select_instruments(_candidates(Tables(spark, sf)))


def _price_docs(t: Tables, kind: str) -> DataFrame:
    """Price documents, one per order, with the dates and prices of its lines."""
    o = _orders(t).withColumn("ticker", F.concat(F.lit("O"), F.col("l_orderkey").cast("string")))
    d = lambda l: F.to_date(l["l_shipdate"])
    seconds = lambda l: F.datediff(d(l), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + 52200
    bad = lambda l: l["l_linenumber"] == 7
    if kind == "csv":
        row = lambda l: F.concat_ws(",", F.when(bad(l), "soon").otherwise(d(l).cast("string")), F.lit("1"),
                                    F.when(l["l_linenumber"] == 6, "x").otherwise(l["l_extendedprice"].cast("string")))
        body = F.concat(F.lit("Date,Open,Close\n"), F.array_join(F.transform("x", row), "\n"))
        return o.select("ticker", F.when(F.col("l_orderkey") % 10 == 9, "No data").otherwise(body).alias("body"))
    null = F.lit(None).cast("double")
    px = lambda l: F.when(bad(l), null).otherwise(l["l_extendedprice"])
    if kind == "chart":
        adj = F.when(F.col("l_orderkey") % 2 == 0, F.transform("x", lambda l: px(l) + 1)).otherwise(F.array().cast("array<double>"))
        result = F.struct(F.transform("x", seconds).alias("timestamp"), F.struct(
            F.array(F.struct(adj.alias("adjclose"))).alias("adjclose"),
            F.array(F.struct(F.transform("x", px).alias("close"))).alias("quote")).alias("indicators"))
        doc = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    else:
        doc = F.struct(F.transform("x", lambda l: F.struct((seconds(l) * 1000).alias("t"), px(l).alias("c"))).alias("results"))
    return o.select("ticker", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def s12_price_csv(spark, sf):
    return market.parse_price_csv(_price_docs(Tables(spark, sf), "csv"))


def s13_chart_json(spark, sf):
    return market.parse_chart_json(_price_docs(Tables(spark, sf), "chart"))


def s14_aggregates_json(spark, sf):
    return market.parse_aggregates_json(_price_docs(Tables(spark, sf), "aggregates"))


def s15_fundamentals_json(spark, sf):
    p = Tables(spark, sf).read("part")
    body = F.struct(F.col("p_retailprice").alias("market_cap"),
                    F.when(F.col("p_size") % 3 == 0, 0.0).when(F.col("p_size") % 3 == 1, F.col("p_size").cast("double")).alias("weighted_shares_outstanding"),
                    (F.col("p_size") * 2.0).alias("share_class_shares_outstanding"))
    docs = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("ticker"),
                    F.to_json(F.struct(F.when(F.col("p_size") != 7, body).alias("results"))).alias("json"))
    return market.parse_fundamentals_json(docs)


def s16_adjusted_price_file(spark, sf):
    """A price file with other column names, written, read back and cleaned."""
    t = Tables(spark, sf)
    n = F.col("l_linenumber")
    rows = _line_parts(t).select(
        F.lower(ticker_of(brand_no())).alias("symbol"),
        F.when(n == 1, "bad").when(n == 2, F.concat(day("l_shipdate").cast("string"), F.lit("T10:00:00Z"))).otherwise(day("l_shipdate").cast("string")).alias("date"),
        F.when(n == 3, "0").when(n == 4, "").otherwise(F.col("l_extendedprice").cast("string")).alias("close"),
        F.when(n == 4, "2.5").alias("price"))
    path = shared_folder(spark, "prices")
    rows.write.option("header", True).csv(path)
    return tables.read_adjusted_prices(spark, path).groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n"), money2("adj_close"))


def s17_form4_aliases(spark, sf):
    """Insider rows as text under other column names and with gaps."""
    t = Tables(spark, sf).trades()
    odd = F.col("shares").cast("int") % 4
    rows = t.select(
        F.lower("ticker").alias("symbol"), F.col("issuer_cik").cast("long").cast("string").alias("issuer_cik"),
        F.when(odd == 0, "").otherwise(F.lower("transaction_code")).alias("code"),
        F.when(odd == 1, F.col("acquired_disposed")).alias("acquired_disposed"),
        F.col("transaction_date").cast("string").alias("txn_date"),
        F.when(odd == 2, F.col("filing_date").cast("string")).alias("accepted_at"),
        F.col("shares").cast("string").alias("transaction_shares"),
        F.when(odd != 3, F.col("price_per_share").cast("string")).alias("price_per_share"),
        F.round(F.col("shares") * F.col("price_per_share"), 2).cast("string").alias("value_usd"),
        F.when(F.col("is_officer"), "Yes").otherwise("no").alias("is_officer"),
        F.when(F.col("is_director"), "indirect").otherwise("").alias("ownership_nature"))
    out = tables.parse_form4_rows(rows)
    return out.groupBy("ticker", "issuer_cik", "transaction_code", "acquired_disposed", "is_officer", "direct").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("shares") * F.col("price_per_share"), 2)), 2).alias("value"),
        F.max("filing_date").alias("last_filed"))


def s18_ticker_list(spark, sf):
    p = Tables(spark, sf).read("part")
    line = F.when(F.col("p_size") % 10 == 0, "# note").when(F.col("p_size") % 10 == 1, "  ").otherwise(
        F.concat(F.lit(" "), F.lower(ticker_of(brand_no())), F.lit(" ")))
    path = shared_folder(spark, "tickers")
    p.select(line.alias("value")).write.text(path)
    return tables.read_tickers(spark, path)


def _history(t: Tables):
    e = t.event_rows()
    scored = e.select(
        F.col("id").alias("seq"), F.element_at(F.array(F.lit("ta"), F.lit("tb"), F.lit("tc")), (F.col("k") % 3 + 1).cast("int")).alias("ticker"),
        F.col("duration_ms").alias("score"), F.when(F.col("k") % 2 == 0, "conviction").otherwise("neutral").alias("quadrant"),
        F.when(F.col("k") % 4 == 0, 30).otherwise(90).alias("w"), "at", "k")
    return scored


def k10_signal_history(spark, sf):
    s = _history(Tables(spark, sf))
    entries = writers.history_entries(s, F.col("w"), "stream", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "test")
    path = shared_folder(spark, "history")
    for window in (30, 90):  # a run appends the windows that it has scored
        writers.append_history(entries.filter(F.col("window_days") == window), path)
    out = spark.read.schema(entries.schema).json(path)
    return out.select("recorded_at", F.col("window_days").cast("long").alias("window_days"), "ticker", "score", "quadrant", "revision_hash")


def s20_read_signal_history(spark, sf):
    """The good records of one ticker and window; some lines are not JSON."""
    s = _history(Tables(spark, sf))
    good = F.to_json(F.struct("seq", F.upper("ticker").alias("ticker"), F.col("w").alias("window_days"), "score", "quadrant"))
    path = shared_folder(spark, "history")
    s.select(F.when(F.col("k") == 50, "{broken").otherwise(good).alias("value")).write.text(path)
    out = tables.parse_signal_history(spark.read.text(path), None, "tb", 90)
    return out.select("seq", "ticker", F.col("window_days").cast("long").alias("window_days"), "score", "quadrant")


def s21_fund_registry(spark, sf):
    """Filings per tracked fund, the suppliers standing in for the tracked ciks in turn."""
    t = Tables(spark, sf)
    fund = F.col("cik").cast("long") % len(registry.TRACKED_FUNDS)
    ciks = F.array(*[F.lit(c.zfill(10)) for _, _, c in registry.TRACKED_FUNDS])
    renamed = t.chain().withColumn("cik", F.element_at(ciks, (fund + 1).cast("int")))
    return renamed.join(F.broadcast(registry.tracked_funds(spark)), "cik").groupBy("cik", "label", "manager").agg(
        F.count(F.lit(1)).alias("filings"))


# -- column functions ------------------------------------------------------------------
def f1_normalize_name(spark, sf):
    c = _companies(Tables(spark, sf))
    return c.select(F.col("file_order"), texts.normalize_name(F.concat(F.lit("The "), "title", F.lit(" & Co. Class A"))).alias("norm"))


def f2_clean_ids(spark, sf):
    c = Tables(spark, sf).read("customer")
    k = F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey", texts.pad_cik(k).alias("padded"), texts.clean_cik(F.concat(F.lit("000"), k)).alias("clean"),
        texts.clean_cik("c_name").alias("bad_cik"), texts.clean_ticker(F.concat(F.lit(" brk."), k)).alias("ticker"),
        texts.clean_ticker("c_name").alias("bad_ticker"))


def f12_f14_dates_and_splits(spark, sf):
    o = Tables(spark, sf).read("orders")
    d = day("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 6
    raw = (F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("T01:02:03Z"))).when(k == 2, F.replace(d, F.lit("-"), F.lit("")))
           .when(k == 3, F.concat(F.lit("  "), d, F.lit(" 10:00:00"))).when(k == 4, "not a date").otherwise(""))
    parsed = values.lenient_date(raw)
    return o.select("o_orderkey", parsed.alias("d"), values.split_of(parsed).alias("split"))


def f13_lenient_numbers(spark, sf):
    l = Tables(spark, sf).read("lineitem")
    n, x = F.col("l_linenumber"), F.col("l_extendedprice").cast("string")
    raw = (F.when(n == 1, x).when(n == 2, "").when(n == 3, "abc").when(n == 4, "NaN").when(n == 5, F.concat(F.lit("-"), x))
           .when(n == 6, "Infinity").otherwise(F.concat(F.lit(" "), x, F.lit(" "))))
    yes = F.when(n == 1, "1").when(n == 2, " TRUE ").when(n == 3, "y").when(n == 4, "Yes").when(n == 5, "0").otherwise("on")
    return l.groupBy("l_linenumber").agg(
        F.count(values.finite_double(raw)).alias("finite"), F.count(values.positive_double(raw)).alias("positive"),
        F.count(values.lenient_double(F.format_number("l_extendedprice", 2))).alias("with_commas"),
        F.round(F.sum(values.finite_double(raw)), 2).alias("total"), F.count_if(values.lenient_bool(yes)).alias("true_flags"))


def f15_lists(spark, sf):
    p = Tables(spark, sf).read("part")
    raw = F.concat_ws(";", F.lit(" a"), F.col("p_name"), F.lit(""), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")))
    parts = texts.split_list(raw)
    return p.select("p_partkey", F.size(parts).cast("long").alias("n"), texts.join_list(parts).alias("joined"))


def f16_time_buckets(spark, sf):
    e = Tables(spark, sf).event_rows()
    return e.groupBy(values.minute_bucket(F.col("at")).alias("minute"), values.day_bucket(F.col("at")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


def f18_provider_symbols(spark, sf):
    p = Tables(spark, sf).read("part")
    raw = F.concat(ticker_of(brand_no()), F.when(F.col("p_size") % 3 == 0, "/B").when(F.col("p_size") % 3 == 1, ".a").otherwise(""))
    return p.select("p_partkey", *[texts.provider_symbol(raw, n).alias(n) for n in ("massive", "yahoo", "stooq")])


def f19_usd_text(spark, sf):
    t = Tables(spark, sf)
    f = t.chain().withColumn("v", F.round("total_value", 2))
    return f.select("accession", texts.format_usd(F.col("v")).alias("usd"), texts.filing_url(F.col("cik"), F.col("accession")).alias("url"))


def f21_client_family(spark, sf):
    e = Tables(spark, sf).telemetry()
    return e.groupBy("client", texts.client_family("client", "codex.*probe").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def f22_list_hash(spark, sf):
    """Hash of the sorted distinct brands bought by each supplier's customers' orders."""
    l = _line_parts(Tables(spark, sf))
    return l.groupBy("l_suppkey").agg(texts.list_hash(F.array_sort(F.collect_set("p_brand"))).alias("hash"))


def f23_counter_sanitizing(spark, sf):
    e = Tables(spark, sf).event_rows()
    v = F.col("duration_ms")
    return e.select("id", values.safe_count(F.floor(v) - 20).alias("count"), values.safe_count(v.cast("string")).alias("from_text"),
                    values.safe_duration(v * 300 - 1000).alias("duration"))


def f27_row_key(spark, sf):
    """Distinct keys among insider rows, and rows a merge would drop."""
    from tidemark.params import FORM4_ROW_KEY
    t = Tables(spark, sf).trades()
    keys = t.groupBy(*FORM4_ROW_KEY).agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("ticker").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("repeats"))


def k7_merge_form4(spark, sf):
    """Old rows, and new rows that restate the purchases with another owner name."""
    t = Tables(spark, sf).trades()
    fresh = t.filter("transaction_code = 'P'").withColumn("owner_name", F.concat("owner_name", F.lit(" (restated)")))
    out = writers.merge_form4_rows(t, fresh)
    return out.groupBy("ticker", "transaction_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("owner_name").endswith("(restated)")).alias("restated"))


def p9_ticker_flags(spark, sf):
    p = Tables(spark, sf).read("part")
    no = brand_no()
    kind = F.col("p_size") % 6
    ticker = (F.when(kind == 0, "").when(kind == 1, F.concat(ticker_of(no), F.lit("USDUSD"))).when(kind == 2, F.concat(ticker_of(no), F.lit("/B")))
              .when(kind == 3, F.concat(ticker_of(no), no)).otherwise(F.lower(ticker_of(no))))
    title = F.concat_ws(" ", F.col("p_type"), F.when(F.col("p_size") % 5 == 0, "conv note 2030").otherwise("COM"))
    return p.select("p_partkey", F.array_join(texts.ticker_flags(ticker, title), ";").alias("flags"))


def _form4_text(t: Tables) -> DataFrame:
    """Insider rows as file text, with errors in some."""
    x = t.trades()
    q = F.col("shares").cast("int")
    return x.select(
        F.when(q == 1, "").when(q == 2, "QQQ").otherwise(F.lower("ticker")).alias("ticker"),
        F.when(q == 3, "").when(q == 4, "77").otherwise(F.col("issuer_cik")).alias("issuer_cik"),
        F.when(q == 5, "").when(q == 6, F.concat("issuer_name", F.lit(" Inc"))).otherwise(F.col("issuer_name")).alias("issuer_name"),
        F.when(q == 7, "").otherwise(F.col("accession")).alias("accession"),
        F.when(q == 8, "??").otherwise(F.col("filing_date").cast("string")).alias("filing_date"),
        F.when(q == 9, "").otherwise(F.col("transaction_date").cast("string")).alias("transaction_date"),
        "owner_cik", F.when(q == 10, "Z").otherwise(F.col("transaction_code")).alias("transaction_code"),
        F.when(q == 11, "").otherwise(F.col("acquired_disposed")).alias("acquired_disposed"),
        F.when(q == 12, "-3").when(q == 13, "many").otherwise(F.col("shares").cast("string")).alias("shares"),
        F.when(q == 14, "-1").when(q == 15, "").otherwise(F.col("price_per_share").cast("string")).alias("price_per_share"))


def _form4_check_inputs(t: Tables):
    universe = _line_parts(t).select(ticker_of(brand_no()).alias("ticker")).distinct().unionByName(
        t.spark.createDataFrame([("ZZZ",)], "ticker string"))
    # A row per ticker, asked for more than once: lines are read for it once.
    universe = materialize(universe, "universe")
    return _form4_text(t), universe, F.lit("2021-02-01").cast("date"), F.lit("2027-09-30").cast("date")


def a17_form4_validation(spark, sf):
    return insider.validate_form4(*_form4_check_inputs(Tables(spark, sf)))


def a17_form4_problems(spark, sf):
    bad = insider.form4_row_problems(*_form4_check_inputs(Tables(spark, sf)))
    return bad.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def a17_form4_code_counts(spark, sf):
    return insider.form4_code_counts(_form4_text(Tables(spark, sf)))


def o3_missing_and_unexpected(spark, sf):
    """Tickers of the list without rows, and tickers of the file outside the list."""
    rows, universe, *_ = _form4_check_inputs(Tables(spark, sf))
    seen = rows.select(F.upper("ticker").alias("ticker")).filter("ticker <> ''")
    return universe.subtract(seen).withColumn("side", F.lit("missing")).unionByName(
        seen.subtract(universe).withColumn("side", F.lit("unexpected")))


# -- resolution chain ---------------------------------------------------------------------
NOW = "2024-06-01 00:00:00"


def _chain_inputs(t: Tables):
    p = t.read("part").withColumn("no", brand_no().cast("int"))
    code = lambda: F.element_at(F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]),
        F.array(*[F.lit(x) for x in ("100", "200", "300", "400", "500", "600")])), F.col("p_type"))
    securities = p.groupBy("no", "p_type").agg(F.min("p_name").alias("p_name")).withColumn(
        "cusip", F.concat(F.lit("BR"), F.lpad(F.col("no").cast("string"), 4, "0"), code()))
    items = securities.select(F.lower("cusip").alias("cusip"), F.concat("p_name", F.lit(" Corp")).alias("issuer"))
    tick = ticker_of(F.col("no").cast("string"))
    none = F.lit(None).cast("string")
    now = F.to_timestamp(F.lit(NOW))
    cache = securities.filter("no % 5 = 0").select(
        "cusip", F.when(F.col("p_type") != "LARGE", tick).alias("ticker"), F.upper("p_name").alias("name"), none.alias("figi"),
        F.lit("openfigi").alias("source"),
        F.when(F.col("p_type") == "LARGE", 0.0).when(F.col("p_type") == "SMALL", 0.4).otherwise(0.95).alias("confidence"),
        (now - F.make_interval(days=F.col("no") * 3)).alias("resolved_at"))
    overrides = securities.filter("p_type = 'PROMO' and no % 4 = 1").select("cusip", F.concat(F.lit("M"), tick).alias("ticker"), F.col("p_name").alias("name"))
    mapping = securities.filter("p_type = 'STANDARD'").select(
        "cusip", F.when(F.col("no") % 3 != 0, tick).alias("ticker"), F.concat("p_name", F.lit(" Inc")).alias("name"), F.lit("BBG").alias("figi"))
    # Some names are not in the list under which their securities are looked up.
    unlisted = F.col("title").rlike("^(red|old) ")
    names = resolve.name_index(_companies(t).withColumn("title", F.when(unlisted, F.concat(F.lit("unlisted "), "title")).otherwise(F.col("title"))))
    return items, cache, overrides, mapping, names, now


def j6_resolution_chain(spark, sf):
    return resolve.resolve_chain(*_chain_inputs(Tables(spark, sf))).select("cusip", "ticker", "name", "source", "confidence")


def j7_j8_prefix_and_name_hits(spark, sf):
    """How many securities each step of the chain answers."""
    r = resolve.resolve_chain(*_chain_inputs(Tables(spark, sf)))
    return r.groupBy("source", "confidence").agg(F.count(F.lit(1)).alias("n"))


def _resolved_brands(t: Tables) -> DataFrame:
    """One answer per held security, taken from the chain's securities of the brand."""
    r = resolve.resolve_chain(*_chain_inputs(t))
    held = F.concat(F.substring("cusip", 1, 6), F.lit("100"))
    best = F.struct("confidence", "ticker", "name", "source")
    return r.filter("ticker is not null").groupBy(held.alias("cusip")).agg(F.max(best).alias("b")).select("cusip", "b.*")


def _open_holdings(t: Tables) -> DataFrame:
    none = F.lit(None)
    return t.holdings().withColumns({
        "figi_name": F.when(F.col("put_call") == "", F.col("issuer")), "ticker_source": none.cast("string"),
        "ticker_confidence": none.cast("double")})


def k3_apply_resolutions(spark, sf):
    t = Tables(spark, sf)
    out = resolve.apply_resolutions(_open_holdings(t), _resolved_brands(t))
    return out.groupBy("cusip", "ticker", "ticker_source", "backfilled").agg(F.count(F.lit(1)).alias("n"), F.count("figi_name").alias("named"))


def k4_resolve_sweep(spark, sf):
    """The unresolved tail sent through the chain; how many securities each source fills."""
    t = Tables(spark, sf)
    from tidemark.operators.consensus import unresolved_tail
    tail = unresolved_tail(t.snapshots(weights=False)).select("cusip", "issuer")
    _, cache, overrides, mapping, names, now = _chain_inputs(t)
    r = resolve.resolve_chain(tail, cache, overrides, mapping, names, now)
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("ticker").alias("applied"))


def j20_enrich_positions(spark, sf):
    t = Tables(spark, sf)
    out = resolve.enrich_positions(t.holdings(), _resolved_brands(t))
    return out.groupBy("put_call", "ticker", "ticker_source").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


def a5_coverage_by_source(spark, sf):
    t = Tables(spark, sf)
    from tidemark.operators.consensus import coverage_by_source
    out = coverage_by_source(resolve.enrich_positions(t.holdings(), _resolved_brands(t)))
    return out.select("accession", "ticker_source", "n_resolved", money("value_resolved"))


def l4_worst_unresolved(spark, sf):
    """Largest three positions without a ticker of each filing."""
    t = Tables(spark, sf)
    out = resolve.portfolio_tail(t.holdings().withColumn("value_usd", F.round("value_usd", 2)), 3)
    return out.select("accession", F.col("tail_rank").cast("long").alias("tail_rank"), "cusip", "value_usd")


def u6_manual_overrides(spark, sf):
    """Only the override map: whatever it names is final."""
    t = Tables(spark, sf)
    items, cache, overrides, mapping, names, now = _chain_inputs(t)
    r = resolve.resolve_chain(items, cache.limit(0), overrides, mapping.limit(0), names.limit(0), now)
    return r.filter("source = 'manual'").select("cusip", "ticker", "confidence")


# -- stored tables ----------------------------------------------------------------------------
def k1_replace_filings(spark, sf):
    """Holdings after the newest quarter's filings were saved again with doubled shares."""
    t = Tables(spark, sf)
    stored = t.holdings()
    newest = stored.agg(F.max("report_date").alias("d"))
    batch = stored.filter(F.col("report_date") == newest.scalar()).withColumn("shares", F.col("shares") * 2)
    out = writers.replace_filings(stored, batch)
    return out.groupBy("report_date").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


def k1_partition_overwrite(spark, sf):
    """The written table: a rerun of one quarter replaces that quarter only."""
    t = Tables(spark, sf)
    stored = t.holdings()
    path = shared_folder(spark, "holdings")
    writers.write_holdings(stored, path)
    newest = stored.agg(F.max("report_date").alias("d"))
    batch = stored.filter(F.col("report_date") == newest.scalar()).withColumn("shares", F.col("shares") * 2)
    writers.write_holdings(batch, path)
    return spark.read.schema(stored.schema).parquet(path).groupBy("report_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


def k2_upsert_funds(spark, sf):
    t = Tables(spark, sf)
    s = t.read("supplier")
    cik = F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik")
    even, third = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0
    stored = s.filter(~third).select(cik, F.col("s_name").alias("label"), F.lit("old").alias("manager"))
    batch = s.filter(F.col("s_suppkey") % 3 != 1).select(cik, F.upper("s_name").alias("label"), F.when(even, "new").alias("manager"))
    return writers.upsert_funds(stored, batch)


def k5_incremental_sync(spark, sf):
    """Preferred filings per quarter that are not stored yet, beside a forced run."""
    t = Tables(spark, sf)
    from tidemark.operators.holdings import filing_totals, preferred_filings
    index = preferred_filings(filing_totals(t.holdings()))
    stored = index.filter(F.col("report_date") < F.lit("2026-01-01").cast("date"))
    new = writers.new_filings(index, stored).withColumn("run", F.lit("new"))
    return new.unionByName(writers.new_filings(index, stored, force=True).withColumn("run", F.lit("forced"))).groupBy("run", "form").agg(
        F.count(F.lit(1)).alias("n"))


def p6_stored_accessions(spark, sf):
    t = Tables(spark, sf)
    filings = t.chain().select("accession", "cik")
    index = t.holdings().select("accession", "cik").distinct()
    known = index.join(filings.select("accession"), "accession", "left_semi").withColumn("stored", F.lit(True))
    new = index.join(filings.select("accession"), "accession", "left_anti").withColumn("stored", F.lit(False))
    return known.unionByName(new).groupBy("cik", "stored").agg(F.count(F.lit(1)).alias("n"))


def o1_union_with_override(spark, sf):
    """Old and new fund rows under one key; the new row wins."""
    t = Tables(spark, sf)
    old = t.funds().select("cik", "label").withColumn("_new", F.lit(0))
    new = t.flawed_funds().withColumn("_new", F.lit(1))
    return old.unionByName(new).groupBy("cik").agg(F.max_by("label", "_new").alias("label"))


QUERIES = {f.__name__: f for f in (
    s1_info_table_xml, s2_quarantined_documents, s3_form4_xml, s4_malformed_skipped, s5_filing_index, s5_originals_only,
    s6_form4_index, s7_pick_info_table, s8_pick_ownership, s9_name_index, s10_ticker_cik_map, s11_select_instrument,
    s12_price_csv, s13_chart_json, s14_aggregates_json, s15_fundamentals_json, s16_adjusted_price_file,
    s17_form4_aliases, s18_ticker_list, s20_read_signal_history, s21_fund_registry, k8_form4_rows, k8_form4_summary,
    p13_issuer_guard, j11_ticker_cik_misses, k10_signal_history, f1_normalize_name, f2_clean_ids,
    f12_f14_dates_and_splits, f13_lenient_numbers, f15_lists, f16_time_buckets, f18_provider_symbols, f19_usd_text,
    f21_client_family, f22_list_hash, f23_counter_sanitizing, f27_row_key, k7_merge_form4, p9_ticker_flags,
    a17_form4_validation, a17_form4_problems, a17_form4_code_counts, o3_missing_and_unexpected, j6_resolution_chain,
    j7_j8_prefix_and_name_hits, k3_apply_resolutions, k4_resolve_sweep, j20_enrich_positions, a5_coverage_by_source,
    l4_worst_unresolved, u6_manual_overrides, k1_replace_filings, k1_partition_overwrite, k2_upsert_funds,
    k5_incremental_sync, p6_stored_accessions, o1_union_with_override,
)}
