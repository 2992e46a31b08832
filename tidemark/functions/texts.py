"""Names, identifiers, labels and short texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.values import col, text

# Words dropped from company names before two names are compared.
NAME_NOISE = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COMPANIES",
    "LTD", "LIMITED", "LLC", "LP", "PLC", "NV", "SA", "AG", "SE", "THE",
    "COM", "CL", "CLASS", "A", "B", "C", "HLDG", "HLDGS", "HOLDING", "HOLDINGS",
    "GROUP", "GRP", "TR", "TRUST", "FUND", "ADR", "ADS", "SPONSORED", "NEW",
]

# What marks a ticker or title that daily prices cannot be matched to.
PRICEABLE_TICKER = r"^[A-Z]{1,5}([./][A-Z]{1,2})?$"
CURRENCY_SUFFIXES = ["USD", "EUR", "CHF", "GBP"]
TITLE_HINTS = [
    "NOTE", "NOTES", "NT ", "BOND", "DEBENTURE", "DEB ",
    "CONV", "CONVERTIBLE", "PFD", "PREF", "PREFERRED",
    "WARRANT", "WRT", "RIGHT", "UNIT",
]

# Title words of the top executives.
C_SUITE_WORDS = ["chief executive", "ceo", "chief financial", "cfo", "president", "chair"]

# Agent names and the family they count under; first match decides.
CLIENT_FAMILIES = [
    ("codex", "Codex"),
    ("chatgpt|openai", "ChatGPT"),
    ("claude|anthropic", "Claude"),
    ("cursor", "Cursor"),
    ("windsurf|codeium", "Windsurf"),
    ("visual studio|vscode", "VS Code"),
    (r"\bcline\b", "Cline"),
    (r"mcp.?inspector|\binspector\b", "MCP Inspector"),
]
OTHER_FAMILY = "Other MCP clients"


def normalize_name(c: Column | str) -> Column:
    """Upper-case words of a company name without punctuation and legal-form noise."""
    words = F.split(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9 ]", " "), " +")
    noise = F.array(*[F.lit(w) for w in NAME_NOISE])
    return F.array_join(
        F.filter(words, lambda w: (w != "") & ~F.array_contains(noise, w)), " "
    )


def pad_cik(c: Column | str) -> Column:
    """Ten digits; longer ids stay whole."""
    raw = text(c)
    return F.when(F.length(raw) < 10, F.lpad(raw, 10, "0")).otherwise(raw)


def clean_cik(c: Column | str) -> Column:
    """Ten digits after removing zeros on the left, null when it is no id."""
    bare = F.ltrim(text(c), F.lit("0"))
    bare = F.when(bare == "", F.lit("0")).otherwise(bare)
    return F.when(bare.rlike("^[0-9]{1,10}$"), F.lpad(bare, 10, "0"))


def clean_ticker(c: Column | str) -> Column:
    t = F.upper(text(c))
    return F.when(t.rlike(r"^[A-Z0-9.\-]{1,12}$"), t)


def ticker_problems(ticker: Column | str, title: Column | str) -> dict[str, Column]:
    """Reasons why a line with a ticker cannot be priced as common stock, sorted, each with its test."""
    t = F.upper(text(ticker))
    title = F.upper(F.coalesce(col(title), F.lit("")))
    suffixed = F.lit(False)
    for suffix in CURRENCY_SUFFIXES:
        suffixed = suffixed | (t.endswith(suffix) & (F.length(t) > 5))
    hinted = F.lit(False)
    for hint in TITLE_HINTS:
        hinted = hinted | title.contains(hint)
    return {"currency_suffixed_ticker": suffixed, "non_common_equity_title": hinted, "non_priceable_ticker": ~t.rlike(PRICEABLE_TICKER)}


def ticker_flags(ticker: Column | str, title: Column | str) -> Column:
    """Sorted reasons why a line cannot be priced as common stock; empty when it can."""
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in ticker_problems(ticker, title).items()]))
    return F.when(F.upper(text(ticker)) == "", F.array(F.lit("missing_ticker"))).otherwise(flags)


def is_c_suite(is_officer: Column, title: Column) -> Column:
    return is_officer & F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(C_SUITE_WORDS))


def role_label(is_officer: Column, is_director: Column, is_owner: Column, title: Column) -> Column:
    title_or = lambda default: F.coalesce(F.nullif(title, F.lit("")), F.lit(default))
    return (
        F.when(is_c_suite(is_officer, title), title_or("C-Suite"))
        .when(is_officer, title_or("Officer"))
        .when(is_director, F.lit("Director"))
        .when(is_owner, F.lit("10% Owner"))
        .otherwise(F.lit("Insider"))
    )


def provider_symbol(ticker: Column | str, provider: str) -> Column:
    """Spelling of a ticker at a price provider."""
    t = F.upper(text(ticker))
    if provider == "massive":
        return F.replace(t, F.lit("/"), F.lit("."))
    if provider == "yahoo":
        return F.translate(t, "/.", "--")
    if provider == "stooq":
        return F.concat(F.translate(F.lower(t), "./", "--"), F.lit(".us"))
    raise ValueError("provider must be massive, stooq or yahoo")


def format_usd(c: Column) -> Column:
    """$1.2B / $3.4M / $5.6K / $789."""
    size = F.abs(c)
    scaled = lambda div, unit: F.concat(F.lit("$"), F.format_number(F.round(c / div, 1), 1), F.lit(unit))
    return (
        F.when(size >= 1e9, scaled(1e9, "B"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "K"))
        .otherwise(F.concat(F.lit("$"), F.format_number(F.round(c, 0), 0)))
    )


def short_usd(c: Column) -> Column:
    """Compact dollars of the rationale text: $1.2M, $35K, $7."""
    return (
        F.when(c >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", F.round(c / 1e6, 1)), F.lit("M")))
        .when(c >= 1e3, F.concat(F.lit("$"), F.format_string("%.0f", F.round(c / 1e3, 0)), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_string("%.0f", F.round(c, 0))))
    )


def filing_url(cik: Column, accession: Column) -> Column:
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"),
        cik.cast("long").cast("string"),
        F.lit("/"),
        F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"),
    )


def severity(ratio: Column) -> Column:
    return F.when(ratio >= 1000, "critical").when(ratio >= 250, "high").otherwise("review")


def client_family(c: Column | str, probe_pattern: str | None = None, probe_family: str = "Own probes") -> Column:
    """Family of a self-declared agent name."""
    name = F.lower(F.coalesce(col(c), F.lit("")))
    rules = ([(probe_pattern, probe_family)] if probe_pattern else []) + CLIENT_FAMILIES
    out = None
    for pattern, family in rules:
        out = F.when(name.rlike(pattern), family) if out is None else out.when(name.rlike(pattern), family)
    return out.otherwise(OTHER_FAMILY)


def split_list(c: Column | str, separator: str = ";") -> Column:
    """Trimmed non-blank parts of a separated list."""
    return F.filter(F.transform(F.split(text(c), separator), lambda x: F.trim(x)), lambda x: x != "")


def join_list(c: Column | str, separator: str = ";") -> Column:
    return F.array_join(F.filter(col(c), lambda x: x.isNotNull() & (x != "")), separator)


def list_hash(c: Column | str) -> Column:
    """SHA-256 of the compact JSON text of a list of strings."""
    return F.sha2(F.to_json(col(c)), 256)


def alert_severity(action: Column) -> Column:
    """3 for alert, 2 for watch; other actions raise no alert."""
    return F.when(F.lower(action) == "alert", 3).when(F.lower(action) == "watch", 2)
