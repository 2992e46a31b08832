"""The alert that a filing raises: its counts, its largest moves of each class, and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.texts import filing_url
from tidemark.operators import moves as mv

# Headings of the classes of moves, in the order of a message.
HEADINGS = {"NEW": "New", "EXIT": "Exited", "ADD": "Added", "TRIM": "Trimmed"}


def subject_line(prefix: str = ""):
    bits = F.array_compact(F.array(
        F.when(F.col("n_new") > 0, F.concat(F.col("n_new").cast("string"), F.lit(" new"))),
        F.when(F.col("n_exit") > 0, F.concat(F.col("n_exit").cast("string"), F.lit(" exits")))))
    head = F.when(F.size(bits) > 0, F.array_join(bits, ", ")).otherwise("filing update")
    amended = F.when(F.col("form").endswith("/A"), " (amendment)").otherwise("")
    return F.concat(F.lit(prefix), "label", F.lit(" 13F"), amended, F.lit(" ("), F.col("report_date").cast("string"), F.lit("): "), head)


def quarter_line():
    versus = F.coalesce(F.concat(F.lit(" vs "), F.col("prev_report_date").cast("string")), F.lit(" (first filing on record)"))
    return F.concat(F.lit("Quarter "), F.col("report_date").cast("string"), versus, F.lit(" | filed "),
                    F.col("filing_date").cast("string"), F.lit(" | "), F.col("form"))


def top_moves(moves: DataFrame, n: int = 15) -> DataFrame:
    """The n largest moves of each class per fund and quarter, with what a message says of them."""
    ranked = mv.rank_moves(moves.filter(F.col("move").isin(*HEADINGS)), "cik", "report_date").filter(F.col("move_rank") <= n)
    shown = F.concat(F.when(F.coalesce("ticker", F.lit("")) != "", F.concat("ticker", F.lit(" "))).otherwise(""), F.coalesce("issuer", F.lit("")))
    return ranked.select("cik", "report_date", "move", "move_rank", "cusip", "put_call", mv.move_detail().alias("detail"), shown.alias("shown"))


def filing_messages(filings: DataFrame, moves: DataFrame, funds: DataFrame, n: int = 15, prefix: str = "") -> DataFrame:
    """A message per filing: cik, accession, counts, subject and body. ``filings`` are resolved ones with
    prev_report_date; a filing without moves gets a message too.

    A filing's lines are at most n per class, so they fit a row; all moves are counted.
    """
    top = top_moves(moves, n)
    line = F.concat(F.lit("  - "), "shown", F.lit(": "), "detail")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("move") == kind, F.struct("move_rank", line.alias("line")))))
    lines = top.groupBy("cik", "report_date").agg(*(of(kind).alias(f"l_{kind}") for kind in HEADINGS))
    rows = filings.join(mv.move_counts(moves, "cik", "report_date"), ["cik", "report_date"], "left").join(
        lines, ["cik", "report_date"], "left").join(funds, "cik")
    rows = rows.withColumns({f"n_{m}": F.coalesce(f"n_{m}", F.lit(0)) for m in ("new", "exit", "add", "trim")})
    sections = [
        F.when(F.size(f"l_{kind}") > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(f"l_{kind}", lambda x: x["line"]), "\n"), F.lit("\n")))
        for kind, title in HEADINGS.items()]
    who = F.when(F.coalesce("manager", F.lit("")) != "", F.concat("label", F.lit(" — "), "manager"))
    subject = subject_line(prefix)
    # concat_ws leaves out what is null: the manager, and classes without moves.
    body = F.concat_ws("\n", subject, F.lit(""), who, quarter_line(), F.lit(""), *sections, filing_url(F.col("cik"), F.col("accession")))
    return rows.select("cik", "accession", subject.alias("subject"), body.alias("body"), "n_new", "n_exit", "n_add", "n_trim")
