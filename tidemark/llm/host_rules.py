"""Quality rules of documents and of the hosts they come from, in DataFrame operations only.

Every document is measured by itself. A host's failures of each rule are counted, its failure rate
is shrunk by a beta prior fitted to all hosts, and a host fails when its rate is very likely above
a limit; its documents then fail with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import materialize

#: What parts words, for Java's and RE2's regular expressions alike.
GAP = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Words in a window that is looked for again in the text.
WINDOW = 5


def measures(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host and the counts of each document's rules; a null text has no words.

    Windows are compared by 64-bit hashes of their words, sorted within the document: the cost
    grows with n log n, also for very long texts of repeats.
    """
    rows = docs.select("doc_id", F.col(host).alias("host"), common.text_of().alias("text"))
    words = F.array_remove(F.split("text", f"{GAP}+", -1), "")
    rows = rows.withColumn("words", words).withColumn("n_words", F.size("words").cast("long"))
    at = F.sequence(F.lit(0), F.size("words") - WINDOW)
    window = F.transform(at, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    rows = rows.withColumn("hashes", F.when(F.size("words") > WINDOW, window))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda k: F.get("sorted", k)["h"]
    again = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
    rows = rows.withColumn("again", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(again, lambda k: F.get("sorted", k)["i"]))))
    # A window covers its words, less those that the one before has covered.
    new = F.transform("again", lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("again", k - 1))).cast("long"))
    covered = F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id", "host", "n_words",
        (F.char_length("text") - F.regexp_count("text", F.lit(GAP))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"))


def document_rules() -> dict[str, Column]:
    """Rules that a document fails by itself."""
    return {
        "short": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    }


def host_rules() -> dict[str, Column]:
    """Rules whose failures speak about a host; those of documents among them."""
    return document_rules() | {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "same_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": ~(F.col("word_chars").between(3 * F.col("n_words"), 15 * F.col("n_words"))),
    }


def host_verdicts(measured: DataFrame, limit: float = 0.5, certainty: float = 3.0) -> DataFrame:
    """Per host: documents, shrunken failure rate of each rule, and the verdict.

    The prior has the mean of all documents and the spread between hosts that is left when chance
    within hosts is taken off (method of moments). A host fails when, for some rule, its posterior
    mean less `certainty` posterior standard deviations is above `limit`. Documents without a host
    form a host of their own.
    """
    rules = host_rules()
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(rule.cast("long")).alias(name) for name, rule in rules.items()))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in rules)).first()
    if not total["n"]:
        return hosts.select("host", "n", *(F.lit(0.0).alias(f"{x}_rate") for x in rules), F.lit(False).alias("host_failed"))
    mean = {x: total[x] / total["n"] for x in rules}
    spread = hosts.agg(*((F.sum(F.col("n") * F.pow(F.col(x) / F.col("n") - mean[x], 2)) / total["n"]).alias(x) for x in rules)).first()
    failed, rates = F.lit(False), []
    for x in rules:
        chance = mean[x] * (1 - mean[x])
        between = spread[x] - chance * total["hosts"] / total["n"]
        weight = max(chance / between - 1, 1e-3) if between > 0 else float(total["n"])
        size = F.col("n") + weight
        rate = (F.col(x) + weight * mean[x]) / size
        failed = failed | (rate - certainty * F.sqrt(rate * (1 - rate) / (size + 1)) > limit)
        rates.append(rate.alias(f"{x}_rate"))
    return hosts.select("host", "n", *rates, failed.alias("host_failed"))


def judged(docs: DataFrame, host: str = "source", limit: float = 0.5, certainty: float = 3.0) -> DataFrame:
    """Measures of every row, base_failed, host_failed and kept.

    Rows without a text fail as short ones; repeated rows are judged each; an empty table gives no
    rows. Hosts are joined by equality of their small table, which Spark broadcasts if its files are
    small enough and splits by skew otherwise.
    """
    measured = materialize(measures(docs, host), "measures")
    verdicts = materialize(host_verdicts(measured, limit, certainty).select(F.col("host").alias("_host"), "host_failed"), "verdicts")
    base = F.lit(False)
    for rule in document_rules().values():
        base = base | rule
    joined = measured.withColumn("base_failed", base).join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(common.read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rule_sql(name: str) -> str:
    """Whether a host fails a rule: its shrunken rate is above one half by three standard deviations."""
    rate = f"({name} + weight * mean) / (n + weight)"
    return f"""SELECT host FROM (
  SELECT h.host, {rate} AS rate, h.n + weight AS size FROM hosts h, (
    SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(mean * (1 - mean) / between_hosts - 1, 1e-3::DOUBLE) ELSE total::DOUBLE END AS weight FROM (
      SELECT mean, total, spread - mean * (1 - mean) * count / total AS between_hosts FROM (
        SELECT any_value(m.mean) AS mean, any_value(m.total) AS total, count(*) AS count, sum(n * pow({name} / n::DOUBLE - m.mean, 2)) / any_value(m.total) AS spread
        FROM hosts, (SELECT sum({name}) / sum(n)::DOUBLE AS mean, sum(n) AS total FROM hosts) m))))
WHERE rate - 3 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5"""


OP8_SQL = rf"""
WITH given AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM given
), placed AS (
  SELECT row, unnest(words) AS word, unnest(range(len(words))) AS i FROM worded
), windows AS (
  SELECT row, i, string_agg(word, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle,
    count(*) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS size FROM placed
), again AS (
  SELECT row, i FROM windows WHERE size = 5 QUALIFY count(*) OVER (PARTITION BY row, shingle) > 1
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY row
), measured AS (
  SELECT w.row, doc_id, host, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM worded w LEFT JOIN covered c USING (row)
), judged AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
    10 * n_dup_lines > 3 * n_lines AS same_lines, NOT word_chars BETWEEN 3 * n_words AND 15 * n_words AS word_length FROM measured
), hosts AS (
  SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({x}) AS {x}" for x in ("short", "repeats", "symbols", "same_lines", "word_length"))} FROM judged GROUP BY host
), failed AS (
  {" UNION ".join(rule_sql(x) for x in ("short", "repeats", "symbols", "same_lines", "word_length"))}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.host IS NOT DISTINCT FROM j.host) AS kept
FROM judged j
"""
