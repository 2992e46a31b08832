"""Repair of conversations by a lightest derivation (Knuth's generalisation of Dijkstra's search).

A derivation reads a conversation's rows in order and keeps, re-roles or deletes each, or inserts
rows between them, so that the roles left read `(s?(ua)+)?`. Items are deductions "rows i to j can be
repaired so that the roles lead from state p to state q"; their weight is (cost, audit), the audit
being the initials of the edits. Rules are weighted hyperedges: an item and a row give a longer
item, an item and the item that continues it give their union. Adding to a cost and appending to an
audit never makes a weight smaller, and of two audits of one item neither begins the other, since
every item ends with an edit of a row; so the rules are monotone, and an item that is popped from
the agenda is final.

Conversations of any length: rows are dealt to tasks by ranges of (conversation, turn, role), never by
conversation alone. A task derives the items of pieces of at most PIECE rows; the few items of each
piece then meet per conversation. Texts stay out of this: rows carry the SHA-256 of their text until
the edits are known, and only then the texts stream by in order.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import common
from tidemark.session import materialize

SPACES = " \t\n\x0b\x0c\r"
#: Rows whose items are derived together.
PIECE = 256
#: States of the roles so far: nothing, the system's row, a user's row, a whole exchange.
START, SYSTEM, USER, WHOLE = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): WHOLE, (WHOLE, "u"): USER}
#: Inserted rows that end a conversation from a state.
ENDING = {START: 0, SYSTEM: 2, USER: 1, WHOLE: 0}
ROLES = {USER: "user", WHOLE: "assistant"}


@dataclass(frozen=True)
class Costs:
    """Of edits; `truncated` is added for a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def moves(state: int, symbol: str, costs: Costs) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of each edit of a row. A symbol is the row's role initial, `x` for
    any other than s, u and a, in capitals if the row is truncated; `d` for one that has to go."""
    yield costs.delete, "D", state
    if symbol == "d":
        return
    extra = costs.truncated if symbol.isupper() else 0
    if (state, symbol.lower()) in NEXT:
        yield extra, "K", NEXT[state, symbol.lower()]
    for initial in "ua":
        if (state, initial) in NEXT:
            yield extra + costs.rerole, "R", NEXT[state, initial]


@functools.lru_cache(65536)
def lightest(symbols: str, state: int, costs: Costs) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from `state` over all of symbols to each state that can be reached."""
    agenda = [(0, "", 0, state)]
    final: set[tuple[int, int]] = set()
    goals: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == len(symbols):
            goals[q] = (cost, audit)
            continue
        for more, initial, then in moves(q, symbols[i], costs):
            if (i + 1, then) not in final:
                heapq.heappush(agenda, (cost + more, audit + initial, i + 1, then))
        for initial in "ua":
            then = NEXT.get((q, initial))
            if then is not None and (i, then) not in final:
                heapq.heappush(agenda, (cost + costs.insert, audit + "I", i, then))
    return goals


# --- rows, without their texts ---


def described(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text key, and what is wrong with the text; equal rows once, with their number.

    Null roles and texts are one space. An empty role has no initial that fits.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACES))
    rows = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("text_key"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    return rows.groupBy("conv_id", "turn", "role", "text_key").agg(
        F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))


def with_duplicates(rows: DataFrame) -> DataFrame:
    """rows with `seen`: an earlier turn has the same role and text. Nulls count as earliest."""
    turn = F.struct(F.col("turn").isNotNull().alias("is_set"), F.col("turn").alias("at"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k")).agg(F.min(turn).alias("first"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text_key") == F.col("k")))
    return joined.withColumn("seen", ~F.col("turn").eqNullSafe(F.col("first.at"))).drop("c", "r", "k", "first")


def dealt(rows: DataFrame) -> DataFrame:
    """rows in order of (conversation, turn, role, text key), dealt out by ranges of that order, so
    that a conversation or a turn with very many rows is shared by many tasks."""
    order = ["conv_id", "turn", "role", "text_key"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


PIECE_FIELDS = "part int, piece long, symbols string, illegal long, first string, last string, turns array<{turn}>, roles array<string>, keys array<binary>, counts array<int>"


def schema_of(df: DataFrame, fields: str) -> T.StructType:
    """conv_id as df has it, then the fields; {turn} stands for the type of df's turns."""
    kinds = dict(df.dtypes)
    rest = T.StructType.fromDDL(fields.format(turn=kinds["turn"]) if "turn" in kinds else fields)
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *rest])


def pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations: the symbols of their rows, and which rows these are."""
    schema = schema_of(rows, PIECE_FIELDS)
    target = to_arrow_schema(schema)

    @common.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        now: dict | None = None
        number = 0

        def new(conv, part):
            nonlocal number
            number += 1
            return {"conv_id": conv, "part": part, "piece": number, "symbols": [], "illegal": 0, "first": None, "last": None,
                    "turns": [], "roles": [], "keys": [], "counts": []}

        for batch in batches:
            for row in batch.to_pylist():
                initial = row["role"][:1] if row["role"][:1] in ("s", "u", "a") else "x"
                gone = row["blank"] or row["seen"]
                symbol = "d" if gone else initial.upper() if row["truncated"] else initial
                left, lead = row["n"], True
                while left:
                    if now is None or now["conv_id"] != row["conv_id"] or len(now["symbols"]) >= PIECE:
                        if now is not None:
                            made.append(now)
                        now = new(row["conv_id"], row["part"])
                    n = min(left, PIECE - len(now["symbols"]))
                    now["symbols"] += [symbol if lead else "d", *("d" * (n - 1))]
                    pairs = n - 1
                    if now["last"] is None:
                        now["first"] = initial
                    elif now["last"] + initial not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["illegal"] += pairs  # a row never continues an equal one
                    now["last"] = initial
                    for name, value in (("turns", row["turn"]), ("roles", row["role"]), ("keys", row["text_key"]), ("counts", n)):
                        now[name].append(value)
                    left, lead = left - n, False
            if len(made) >= 1000:
                yield emit(made)
                made = []
        if now is not None:
            made.append(now)
        yield emit(made)

    def emit(made: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([m | {"symbols": "".join(m["symbols"])} for m in made], schema=target)

    return rows.mapInArrow(cut, schema)


def derivations(cut: DataFrame, costs: Costs) -> DataFrame:
    """Per conversation the lightest weight of the goal (cost, audit), illegal pairs, and the part of
    the audit that falls to each piece, with the state in which the piece begins.

    The items of a piece are derived for each state that may precede it. A conversation's pieces
    arrive in order; of the items "from its start to here" only the four last ones are kept, each
    with its rank among their audits and a link to the item it came from.
    """
    schema = schema_of(cut, "illegal long, cost long, audit string, path array<struct<part: int, piece: long, state: int, letters: string>>")
    target = to_arrow_schema(schema)
    prices = astuple(costs)

    @common.tidy
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(*prices)
        open_, conv, illegal, last = None, None, 0, None
        out: list[dict] = []

        def finish() -> dict:
            cost, _, state, link = min((cost + costs.insert * ENDING[q], rank, q, link) for q, (cost, rank, link) in open_.items())
            path, tail = [], "I" * ENDING[state]
            while link is not None:
                *step, link = link
                path.append(step)
            path = [{"part": a, "piece": b, "state": p, "letters": x} for a, b, p, x in reversed(path)]
            path[-1]["letters"] += tail
            return {"conv_id": conv, "illegal": illegal, "cost": cost, "audit": "".join(p["letters"] for p in path), "path": path}

        for batch in batches:
            for row in batch.select(["conv_id", "part", "piece", "symbols", "illegal", "first", "last"]).to_pylist():
                if open_ is None or row["conv_id"] != conv:
                    if open_ is not None:
                        out.append(finish())
                    open_, conv, illegal, last = {START: (0, 0, None)}, row["conv_id"], 0, None
                illegal += row["illegal"] + (last is not None and last + row["first"] not in ("su", "ua", "au"))
                last = row["last"]
                best: dict[int, tuple] = {}
                for p, (cost, rank, link) in open_.items():
                    for q, (more, letters) in lightest(row["symbols"], p, costs).items():
                        weight = (cost + more, rank, letters, p, link)
                        if q not in best or weight[:3] < best[q][:3]:
                            best[q] = weight
                order = sorted(best, key=lambda q: best[q][1:3])
                open_ = {q: (best[q][0], order.index(q), (row["part"], row["piece"], best[q][3], best[q][2], best[q][4])) for q in best}
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if open_ is not None:
            out.append(finish())
        yield pa.RecordBatch.from_pylist(out, schema=target)

    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = cut.select("conv_id", "part", "piece", "symbols", "illegal", "first", "last")
    return slim.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(fold, schema)


def edits(cut: DataFrame, derived: DataFrame) -> DataFrame:
    """What stays of each group of equal rows, in order: inserted roles before it, its new role (null: deleted), inserted roles after it."""
    steps = derived.select(F.explode("path").alias("s")).select("s.*")
    joined = cut.select("conv_id", "part", "piece", "turns", "roles", "keys", "counts").join(steps, ["part", "piece"])
    kind = cut.schema["turns"].dataType.elementType.simpleString()
    schema = T.StructType([T.StructField("conv_id", cut.schema["conv_id"].dataType), *T.StructType.fromDDL(
        f"turn {kind}, role string, text_key binary, part int, piece long, before array<string>, new_role string, after array<string>")])
    target = to_arrow_schema(schema)

    @common.tidy
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, at, letters = row["state"], 0, row["letters"]
                groups = list(zip(row["turns"], row["roles"], row["keys"], row["counts"], strict=True))
                for g, (turn, role, key, n) in enumerate(groups):
                    before, own, after = [], None, []
                    while n or (g == len(groups) - 1 and at < len(letters)):
                        letter, at = letters[at], at + 1
                        n -= letter != "I"
                        if letter == "D":
                            continue
                        if letter == "K":
                            state, own = NEXT[state, role[0]], role
                            continue
                        state = next(q for (p, _), q in NEXT.items() if p == state and q in ROLES)
                        if letter == "R":
                            own = ROLES[state]
                        else:
                            (before if own is None else after).append(ROLES[state])
                    if before or own is not None or after:
                        out.append({"conv_id": row["conv_id"], "turn": turn, "role": role, "text_key": key, "part": row["part"],
                                    "piece": row["piece"], "before": before, "new_role": own, "after": after})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return joined.mapInArrow(spell, schema)


def repaired_rows(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step, role, text, in order within tasks, a conversation in one of them.

    Edits and texts are dealt out together and sorted, an edit before the texts it applies to; rows
    stream through, so a long conversation takes no memory.
    """
    texts = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    texts = texts.withColumn("text_key", F.unhex(F.sha2("text", 256)))
    both = changes.withColumn("is_text", F.lit(0)).unionByName(texts.withColumn("is_text", F.lit(1)), allowMissingColumns=True)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_key", "is_text", "part", "piece")
    schema = schema_of(rows.select("conv_id"), "step long, role string, text string")
    target = to_arrow_schema(schema)

    @common.tidy
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, step, started = None, 0, False
        waiting: list[dict] = []  # edits of the group whose text comes next
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not started or row["conv_id"] != conv:
                    conv, step, started, waiting = row["conv_id"], 0, True, []
                if not row["is_text"]:
                    waiting.append(row)
                    continue
                for e in waiting:  # equal rows: the first text serves, others were deleted
                    for role, text in (*((r, "") for r in e["before"]), (e["new_role"], row["text"]), *((r, "") for r in e["after"])):
                        if role is not None:
                            out.append({"conv_id": conv, "step": step, "role": role, "text": text})
                            step += 1
                waiting = []
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return both.select("conv_id", "is_text", "before", "new_role", "after", "text").mapInArrow(render, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the `role:text` lines of each conversation, over rows as repaired_rows gives them."""
    schema = schema_of(repaired.select("conv_id"), "repaired_sha256 string")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state = row["conv_id"], hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{row['role']}:{row['text']}".encode())
            yield pa.RecordBatch.from_pylist(out, schema=target)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema=target)

    return repaired.mapInArrow(run, schema)


def fault_counts(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps of its turns and the rows of each fault. A difference of turns beyond 64 bits gives a null."""
    faults = {
        "blank": F.when(F.col("blank"), F.col("n")),
        "duplicate": F.when(~F.col("blank"), F.col("n") - (~F.col("seen")).cast("long")),
        "truncated": F.when(~F.col("blank") & ~F.col("seen") & F.col("truncated"), F.lit(1)),
    }
    turns = rows.groupBy("conv_id", "turn").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in faults.items()))
    gaps = F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long")), F.count("turn"))
    return turns.groupBy("conv_id").agg(F.when(F.count("turn") > 0, gaps).otherwise(0).alias("gaps"), *(F.sum(k).alias(k) for k in faults))


@dataclass(frozen=True)
class Repair:
    """`report`: a row per conversation with faults, cost and audit. `rows`: the repaired conversations."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, costs: Costs = Costs()) -> Repair:
    """Repair conversations given as (conv_id, turn, role, text); other columns are ignored.

    Rows are taken by turn, nulls first; rows of one turn by role and by the SHA-256 of their text.
    Null conversation ids form one conversation. A row that repeats another in all of this is its
    duplicate. An empty table gives empty tables.
    """
    common.ship(rows.sparkSession)
    known = materialize(with_duplicates(described(rows)), "turns")
    cut = materialize(pieces(dealt(known)), "pieces")
    derived = materialize(derivations(cut, costs), "derivations")
    counts = fault_counts(known).withColumnRenamed("conv_id", "c")
    report = derived.drop("path").join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return Repair(report, repaired_rows(rows, edits(cut, derived)))


def damaged(rows: DataFrame, out_of: int = 20) -> DataFrame:
    """Damage to practise on, drawn by crc32(`conv_id:turn`) % out_of, nulls there one space: 0 drops a row,
    1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 sets its role to user."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                       (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % out_of).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.where("draw != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")


def repaired_conversations(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per conversation of the undamaged rows: what the damage did and how the repair mends it."""
    found = repair(damaged(conversations), costs)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    hashes = digests(found.rows).withColumnRenamed("conv_id", "h")
    joined = ids.join(found.report, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("h")), "left")
    zero = [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return joined.select(
        F.col("id").alias("conv_id"), gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(common.read_table(spark, sf_dir, "conversations"))


#: Steps through rows by position, keeping the least (cost, audit) of each of the four states.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS name FROM conversations
), drawn AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS draw FROM given, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw != 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS c FROM damaged
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id
), inserted AS (
  SELECT * FROM (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)) AS v(p, q, k)
), rules AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(p, c, q)
), edits AS (
  SELECT f.conv_id, f.i, p, p AS q, 2 AS cost, 'D' AS letter FROM faulty f, (VALUES (0), (1), (2), (3)) AS v(p)
  UNION ALL
  SELECT f.conv_id, f.i, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM faulty f JOIN rules r ON r.c = f.c WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.i, p, q, 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'R' FROM faulty f JOIN rules r ON r.c != 's' WHERE fault NOT IN ('blank', 'duplicate')
), walk AS (
  SELECT conv_id, 0::bigint AS i, 0 AS q, {'cost': 0::bigint, 'audit': ''} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q, min({'cost': w.best.cost + 5 * s.k + e.cost, 'audit': w.best.audit || repeat('I', s.k) || e.letter})
  FROM walk w JOIN inserted s ON s.p = w.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = s.q
  GROUP BY w.conv_id, w.i, e.q
), solved AS (
  SELECT c.conv_id, min({'cost': w.best.cost + 5 * s.k, 'audit': w.best.audit || repeat('I', s.k)}) AS best
  FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN inserted s ON s.p = w.q AND (s.q = 3 OR s.q = 0)
  GROUP BY c.conv_id
), letters AS (
  SELECT f.conv_id, f.i, f.role, f.text, substr(replace(best.audit, 'I', ''), f.i::int, 1) AS letter
  FROM faulty f JOIN solved s ON s.conv_id IS NOT DISTINCT FROM f.conv_id
), left_rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i)
    - max((letter = 'K' AND left(role, 1) = 's')::int) OVER (PARTITION BY conv_id) AS place FROM letters WHERE letter != 'D'
), rendered AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS digest
  FROM left_rows GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
  coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(best.cost, 0)::bigint AS cost,
  coalesce(best.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN rendered r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
