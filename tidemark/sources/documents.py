"""Filing documents and filing lists to rows.

Documents are rows of a DataFrame with a text column, so parsing is spread over the
cluster by Spark's own XML and JSON functions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.texts import pad_cik
from tidemark.functions.values import lenient_double, text

XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _record(**fields: T.DataType | str) -> T.StructType:
    kind = lambda t: T.StringType() if t == "s" else t
    return T.StructType([T.StructField(n, kind(t)) for n, t in fields.items()])


VALUE = _record(value="s")
INFO_TABLE = _record(
    infoTable=T.ArrayType(_record(
        nameOfIssuer="s", titleOfClass="s", cusip="s", value="s",
        shrsOrPrnAmt=_record(sshPrnamt="s", sshPrnamtType="s"), putCall="s",
    )),
    _corrupt_record="s",
)
OWNERSHIP = _record(
    periodOfReport="s",
    issuer=_record(issuerCik="s", issuerName="s", issuerTradingSymbol="s"),
    reportingOwner=T.ArrayType(_record(
        reportingOwnerId=_record(rptOwnerCik="s", rptOwnerName="s"),
        reportingOwnerRelationship=_record(isDirector="s", isOfficer="s", isTenPercentOwner="s", officerTitle="s"),
    )),
    nonDerivativeTable=_record(nonDerivativeTransaction=T.ArrayType(_record(
        securityTitle=VALUE, transactionDate=VALUE,
        transactionCoding=_record(transactionCode="s"),
        transactionAmounts=_record(
            transactionShares=VALUE, transactionPricePerShare=VALUE, transactionAcquiredDisposedCode=VALUE),
        postTransactionAmounts=_record(sharesOwnedFollowingTransaction=VALUE),
        ownershipNature=_record(directOrIndirectOwnership=VALUE),
    ))),
    _corrupt_record="s",
)


def reject_reason(xml: Column, max_bytes: int | None = None) -> Column:
    """Why a document is not even parsed: empty, over the caller's limit if there is one, or with
    its own entities anywhere."""
    reason = F.when(xml.isNull() | (F.trim(xml) == ""), "empty")
    if max_bytes is not None:
        reason = reason.when(F.octet_length(xml) > max_bytes, "too_large")
    # The plain search is cheap and rules out nearly all documents.
    return reason.when(xml.contains("<!") & xml.rlike("(?i)<!(DOCTYPE|ENTITY)"), "dtd_or_entity")


def _parse(docs: DataFrame, schema: T.StructType, max_bytes: int | None, dealt: bool = False) -> DataFrame:
    """Documents with the top-level elements as columns and ``reject``. The generator makes
    Spark parse each document once, however many fields are read later.

    Parsing costs far more than moving a document, so documents are first dealt out evenly: a few
    large files, or one, would else be parsed by as many tasks. Rejected ones leave their text behind.
    A caller whose documents lie evenly already says so by ``dealt``, and they are parsed in place."""
    keep = [c for c in docs.columns if c != "xml"]
    checked = docs.withColumn("reject", reject_reason(F.col("xml"), max_bytes))
    safe = F.when(F.col("reject").isNull(), F.col("xml")).alias("xml")
    placed = checked.select(*keep, "reject", safe)
    if not dealt:
        placed = placed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = placed.select(*keep, "reject", F.inline(F.array(F.from_xml("xml", schema, XML_OPTIONS))))
    return parsed.withColumn(
        "reject", F.coalesce("reject", F.when(F.col("_corrupt_record").isNotNull(), "malformed"))
    ).drop("_corrupt_record")


def rejected(docs: DataFrame, kind: str = "13f", max_bytes: int | None = None, dealt: bool = False) -> DataFrame:
    """Side output: documents left out and why. One bad document never stops the batch."""
    schema = INFO_TABLE if kind == "13f" else OWNERSHIP
    keep = [c for c in docs.columns if c != "xml"]
    return _parse(docs, schema, max_bytes, dealt).filter("reject is not null").select(*keep, "reject")


def parse_info_tables(docs: DataFrame, max_bytes: int | None = None, with_rejects: bool = False, dealt: bool = False) -> DataFrame:
    """Holding lines of information-table documents. ``docs`` has an ``xml`` column; its other
    columns are kept. Commas in numbers are dropped, unreadable numbers count as zero.

    ``with_rejects`` adds ``reject`` and, from the same parse, a row for each document left out."""
    keep = [c for c in docs.columns if c != "xml"]
    parsed = _parse(docs, INFO_TABLE, max_bytes, dealt)
    if with_rejects:
        keep.append("reject")
        lines = F.when(F.col("reject").isNull(), F.col("infoTable"))
        rows = parsed.select(*keep, F.posexplode_outer(lines).alias("line_no", "t")).filter("reject is not null or line_no is not null")
    else:
        rows = parsed.filter("reject is null").select(*keep, F.posexplode("infoTable").alias("line_no", "t"))
    number = lambda c: F.coalesce(lenient_double(c), F.lit(0.0))
    return rows.select(
        *keep, "line_no",
        text("t.nameOfIssuer").alias("issuer"),
        text("t.titleOfClass").alias("title_of_class"),
        F.upper(text("t.cusip")).alias("cusip"),
        number("t.value").alias("value"),
        number("t.shrsOrPrnAmt.sshPrnamt").alias("shares"),
        F.coalesce(F.nullif(text("t.shrsOrPrnAmt.sshPrnamtType"), F.lit("")), F.lit("SH")).alias("sh_prn_type"),
        text("t.putCall").alias("put_call"),
    )


TRADE = "nonDerivativeTable.nonDerivativeTransaction"
#: Elements that each column of a parsed trade is read from.
FORM4_ELEMENTS = {
    "filing_date": "periodOfReport",
    "period_of_report": "periodOfReport",
    "issuer_cik": "issuer.issuerCik",
    "issuer_name": "issuer.issuerName",
    "issuer_ticker": "issuer.issuerTradingSymbol",
    "owner_cik": "reportingOwner.reportingOwnerId.rptOwnerCik",
    "owner_name": "reportingOwner.reportingOwnerId.rptOwnerName",
    "officer_title": "reportingOwner.reportingOwnerRelationship.officerTitle",
    "is_officer": "reportingOwner.reportingOwnerRelationship.isOfficer",
    "is_director": "reportingOwner.reportingOwnerRelationship.isDirector",
    "is_ten_percent_owner": "reportingOwner.reportingOwnerRelationship.isTenPercentOwner",
    "security_title": f"{TRADE}.securityTitle.value",
    "transaction_date": f"{TRADE}.transactionDate.value",
    "transaction_code": f"{TRADE}.transactionCoding.transactionCode",
    "acquired_disposed": f"{TRADE}.transactionAmounts.transactionAcquiredDisposedCode.value",
    "shares": f"{TRADE}.transactionAmounts.transactionShares.value",
    "price_per_share": f"{TRADE}.transactionAmounts.transactionPricePerShare.value",
    "shares_owned_after": f"{TRADE}.postTransactionAmounts.sharesOwnedFollowingTransaction.value",
    "direct": f"{TRADE}.ownershipNature.directOrIndirectOwnership.value",
}


def _pruned(schema: T.StructType, paths: set[str], at: str = "") -> T.StructType:
    """The schema without what lies on no path."""
    def kept(kind: T.DataType, here: str) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(kept(kind.elementType, here))
        return _pruned(kind, paths, here + ".") if isinstance(kind, T.StructType) else kind

    return T.StructType([
        T.StructField(f.name, kept(f.dataType, at + f.name)) for f in schema
        if any(p == at + f.name or p.startswith(f"{at}{f.name}.") for p in paths)])


def parse_form4(docs: DataFrame, max_bytes: int | None = None, columns: Iterable[str] | None = None, dealt: bool = False) -> DataFrame:
    """Table I trades of ownership documents. ``docs`` has ``xml``, ``accession`` and
    ``filing_date``; the first reporting owner stands for the filing.

    Turning elements into fields is most of a parse, so a caller may name the ``columns`` it reads:
    elements of others are passed over, and only ``accession`` comes besides."""
    names = [c for c in FORM4_ELEMENTS if columns is None or c in set(columns)]
    # A trade is a row even if nothing of it is read.
    paths = {FORM4_ELEMENTS[c] for c in [*names, "transaction_code"]} | {"_corrupt_record"}
    doc = _parse(docs, _pruned(OWNERSHIP, paths), max_bytes, dealt).filter("reject is null")
    owner = F.get("reportingOwner", F.lit(0))
    role = lambda c: owner["reportingOwnerRelationship"][c]
    flag = lambda c: F.lower(text(c)).isin("1", "true")
    number = lambda c: F.coalesce(lenient_double(c), F.lit(0.0))
    amount = lambda c: F.col(f"t.transactionAmounts.{c}.value")
    default = lambda c, v: F.coalesce(F.nullif(F.upper(text(c)), F.lit("")), F.lit(v))
    period, cik = lambda: text("periodOfReport"), lambda: text("issuer.issuerCik")
    of_filing = {
        "filing_date": lambda: F.when(text("filing_date") == "", period()).otherwise(text("filing_date")),
        "period_of_report": period,
        "issuer_cik": lambda: F.when(cik() == "", "").otherwise(pad_cik(cik())),
        "issuer_name": lambda: text("issuer.issuerName"),
        "issuer_ticker": lambda: F.upper(text("issuer.issuerTradingSymbol")),
        "owner_cik": lambda: text(owner["reportingOwnerId"]["rptOwnerCik"]),
        "owner_name": lambda: text(owner["reportingOwnerId"]["rptOwnerName"]),
        "officer_title": lambda: text(role("officerTitle")),
        "is_officer": lambda: flag(role("isOfficer")),
        "is_director": lambda: flag(role("isDirector")),
        "is_ten_percent_owner": lambda: flag(role("isTenPercentOwner")),
    }
    of_trade = {
        "security_title": lambda: text("t.securityTitle.value"),
        "transaction_date": lambda: text("t.transactionDate.value"),
        "transaction_code": lambda: F.upper(text("t.transactionCoding.transactionCode")),
        "acquired_disposed": lambda: default(amount("transactionAcquiredDisposedCode"), "A"),
        "shares": lambda: number(amount("transactionShares")),
        "price_per_share": lambda: number(amount("transactionPricePerShare")),
        "shares_owned_after": lambda: number("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value"),
        "direct": lambda: default("t.ownershipNature.directOrIndirectOwnership.value", "D").startswith("D"),
    }
    rows = doc.select(
        "accession", *(make().alias(c) for c, make in of_filing.items() if c in names), F.explode(TRADE).alias("t"))
    return rows.select("*", *(make().alias(c) for c, make in of_trade.items() if c in names)).drop("t")


# -- filing lists ----------------------------------------------------------------
_LIST = "form array<string>, accessionNumber array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>"
SUBMISSIONS = f"struct<filings: struct<recent: struct<{_LIST.replace(' array', ': array')}>>>"


def _filing_list(docs: DataFrame) -> DataFrame:
    """Parallel arrays of a submissions document to one row per filing; a shorter array
    leaves '' at its end."""
    keep = [c for c in docs.columns if c != "json"]
    recent = docs.select(*keep, F.from_json("json", SUBMISSIONS)["filings"]["recent"].alias("r"))
    rows = recent.select(*keep, "r", F.posexplode("r.form").alias("pos", "form"))
    at = lambda c: F.coalesce(F.get(f"r.{c}", F.col("pos")), F.lit(""))
    return rows.select(
        *keep, "pos", "form", at("accessionNumber").alias("accession"), at("filingDate").alias("filing_date"),
        at("reportDate").alias("report_date"), at("primaryDocument").alias("primary_doc"),
    )


def list_13f_filings(docs: DataFrame, include_amendments: bool = True) -> DataFrame:
    """Holdings filings of submissions documents (columns ``json`` and any keys)."""
    out = _filing_list(docs).filter(F.col("form").startswith("13F-HR"))
    return out if include_amendments else out.filter(~F.col("form").endswith("/A"))


def list_form4_filings(docs: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Insider filings of submissions documents in list order, leaving out those filed before
    ``since``; at most ``limit`` per document if the caller gives one. The cut is made inside
    each document's own list, before rows are made."""
    keep = [c for c in docs.columns if c != "json"]
    r = docs.select(*keep, F.from_json("json", SUBMISSIONS)["filings"]["recent"].alias("r"))
    zipped = F.transform(
        "r.form",
        lambda form, i: F.struct(
            form.alias("form"),
            F.coalesce(F.get("r.accessionNumber", i), F.lit("")).alias("accession"),
            F.coalesce(F.get("r.filingDate", i), F.lit("")).alias("filing_date"),
        ),
    )
    wanted = lambda x: x["form"].isin("4", "4/A") & (x["accession"] != "") & (
        F.lit(True) if since is None else (x["filing_date"] == "") | (F.substring(x["filing_date"], 1, 10) >= since)
    )
    first = F.filter(zipped, wanted)
    if limit is not None:
        first = F.slice(first, 1, int(limit))
    return r.select(*keep, F.explode(first).alias("f")).select(*keep, "f.*")


# -- documents of a filing package ---------------------------------------------
def pick_info_table(files: DataFrame) -> DataFrame:
    """The holdings document of each filing: the first listed .xml with holdings in it that
    is not the cover page (the cover only if there is no other .xml)."""
    name = F.lower("name")
    xml = files.filter(name.endswith(".xml")).withColumn("cover", name.contains("primary_doc"))
    holds = F.col("content").contains("infoTable") | F.col("content").contains("informationTable")
    best = xml.groupBy("accession").agg(
        F.min("cover").alias("only_cover"),
        F.min(F.when(holds & ~F.col("cover"), F.struct("pos", "name"))).alias("plain"),
        F.min(F.when(holds & F.col("cover"), F.struct("pos", "name"))).alias("from_cover"),
    )
    chosen = F.when(F.col("only_cover"), F.col("from_cover")).otherwise(F.col("plain"))
    return best.select("accession", chosen["name"].alias("name")).filter("name is not null")


def pick_ownership(files: DataFrame) -> DataFrame:
    """The ownership document of each filing: one typed '4' first, else the first plain .xml."""
    name = F.lower("name")
    plain = files.filter(name.endswith(".xml") & ~name.endswith("-index.xml"))
    order = F.struct(F.when(F.col("type") == "4", 0).otherwise(1), F.col("pos"))
    return plain.groupBy("accession").agg(F.min_by("name", order).alias("name"))
