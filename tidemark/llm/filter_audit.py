"""How filters interact: what every order of them removes, step by step, per source.

Each document gets a mask with a bit for each filter that it fails. Per source, the masks are counted
with their labels; these cells, 32 for five filters, are all that the orders need. A recursive common
table expression then extends prefixes of orders by the letters they lack: a row carries the bits
applied so far, joins the cells of its source, and gives the figures of its newest step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import materialize

GAP = r"[\x20\x09-\x0D]"
#: Letter of the filter that removes repeated texts; the others look at one text.
REPEATED = "E"
LETTERS = "ABCDE"


def text_filters() -> dict[str, Column]:
    """Failure conditions of `text`, by letter; `words` holds its words."""
    return {
        "A": F.size("words") < 50,
        "B": 100 * F.size(F.array_distinct("words")).cast("long") < 65 * F.size("words").cast("long"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.char_length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_masks(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, a 256-bit key of the text, and the mask of the filters that look at one text.

    Null texts and parts are empty ones.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), common.text_of().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", f"{GAP}+", -1), ""))
    mask = F.lit(0)
    for letter, fails in text_filters().items():
        mask = mask + F.when(fails, bit(letter)).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `good` and `toxic` (0 or 1); a doc_id that labels list twice has a mark if any row of it has."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def mask_cells(rows: DataFrame) -> DataFrame:
    """(part, cells): documents, good and toxic ones of each mask, with the bit of repeated texts.

    A document fails REPEATED if a smaller doc_id has the same text; a null doc_id is not smaller or
    larger than any, and rows that repeat a doc_id are not smaller than each other. Copies are counted
    per (text, part, labels) before they meet, so thousands of copies of a text become a few rows; of
    each such row only those with the smallest doc_id of the text pass.
    """
    kind = ["text_key", "mask", "part", "good", "toxic"]
    counted = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    counted = counted.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("n_named"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    first = counted.groupBy("text_key").agg(F.min("least.doc_id").alias("first"))
    joined = counted.join(first, "text_key")
    repeated = F.col("n_named") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = joined.withColumn("repeated", repeated).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), (F.col("n") - F.col("repeated")).alias("n")),
            F.struct((F.col("mask") + bit(REPEATED)).alias("mask"), F.col("repeated").alias("n")))).alias("cell"))
    cells = both.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def of_cells(figure: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (total, x) -> total + if({condition}, x.{figure}, 0L))"


#: A prefix of an order, the bits that it has applied, and the figures of its newest step.
WALK = f"""
WITH RECURSIVE walk(part, filters, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT w.part, concat(w.filters, w.letter), w.applied | w.bit, w.step + 1,
    {of_cells('n', 'x.mask & (w.applied | w.bit) = 0')},
    {of_cells('n', 'x.mask & w.bit != 0 AND x.mask & w.applied = 0')},
    {of_cells('n', 'x.mask & w.bit != 0 AND x.mask & w.applied != 0')},
    {of_cells('n', 'x.mask = w.bit')},
    {of_cells('good', 'x.mask & w.bit != 0 AND x.mask & w.applied = 0')},
    {of_cells('toxic', 'x.mask & w.bit != 0 AND x.mask & w.applied = 0')}
  FROM (
    SELECT part, filters, applied, step, letter, shiftleft(1, instr('{LETTERS}', letter) - 1) AS bit
    FROM walk LATERAL VIEW explode(split('{LETTERS}', '')) AS letter
    WHERE step < {len(LETTERS)} AND instr(filters, letter) = 0
  ) w JOIN {{cells}} c ON c.part = w.part
)
SELECT * FROM walk WHERE step > 0 LIMIT ALL
"""


def audited(cells: DataFrame) -> DataFrame:
    """Every step of every order, per part: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley. An order's step has the figures of the prefix that ends there; a prefix of
    k letters begins (5 - k)! orders, which weigh what it removes in the sum over all orders."""
    cells = materialize(cells, "mask-cells")
    walk = materialize(cells.sparkSession.sql(WALK, cells=cells), "prefixes").withColumn("letter", F.substring("filters", -1, 1))
    orders = F.element_at(F.array(*(F.lit(math.factorial(len(LETTERS) - k)) for k in range(1, len(LETTERS) + 1))), F.col("step"))
    shapley = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    full = walk.where(F.col("step") == len(LETTERS)).select(
        "part", F.col("filters").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    full = full.withColumn("filters", F.expr("substring(filter_order, 1, step)"))
    steps = full.join(walk.drop("applied", "step"), ["part", "filters"]).join(shapley, ["part", "letter"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """600 rows per part: the 120 orders of the five filters, with five steps each.

    An empty table has no parts and gives no rows. Labels of documents that don't exist are ignored.
    """
    return audited(mask_cells(labelled(text_masks(docs, part), labels)))


def op12_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(marks.toxic, false) AS toxic,
    (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::int AS mask
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS flag
), walk AS (
  SELECT '' AS filters, 0 AS applied, 0 AS step, '' AS letter, 0 AS flag, 0 AS before
  UNION ALL
  SELECT filters || l.letter, applied | l.flag, step + 1, l.letter, l.flag, applied FROM walk, letters l WHERE applied & l.flag = 0
), figures AS (
  SELECT part, filters, step, walk.letter,
    sum(n) FILTER (mask & applied = 0) AS kept, sum(n) FILTER (mask & flag != 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & flag != 0 AND mask & before != 0) AS redundant, sum(n) FILTER (mask = flag) AS unique_fails,
    sum(good) FILTER (mask & flag != 0 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER (mask & flag != 0 AND mask & before = 0) AS toxic_lost
  FROM walk, cells WHERE step > 0 GROUP BY ALL
), steps AS (
  SELECT f.part, o.filters AS filter_order, f.step, f.letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
  FROM walk o JOIN figures f ON o.step = 5 AND f.filters = left(o.filters, f.step)
)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed,
  coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
  coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::bigint AS shapley
FROM steps
"""
