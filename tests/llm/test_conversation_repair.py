import hashlib
import itertools
import random
import re
import zlib
from dataclasses import replace

import duckdb
import pytest

from tidemark.llm import conversation_repair as cr

SHAPE = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def every_repair(symbols, costs, inserts=1):
    """The least (cost, audit), trying every sequence of edits with up to `inserts` inserted rows."""
    best = None
    for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(symbols) + 1), k) for k in range(inserts + 1)):
        steps = []
        for i in range(len(symbols) + 1):
            steps += ["I"] * places.count(i) + ([symbols[i]] if i < len(symbols) else [])
        options = []
        for s in steps:
            if s == "I":
                options.append([("I", "u", costs.insert), ("I", "a", costs.insert)])
                continue
            choices = [("D", "", costs.delete)]
            if s != "d":
                extra = costs.truncated if s.isupper() else 0
                choices += [("K", s.lower(), extra), ("R", "u", extra + costs.rerole), ("R", "a", extra + costs.rerole)]
            options.append(choices)
        for combo in itertools.product(*options):
            if SHAPE.fullmatch("".join(c[1] for c in combo)):
                weight = (sum(c[2] for c in combo), "".join(c[0] for c in combo))
                best = weight if best is None else min(best, weight)
    return best


def goal(goals, costs):
    return min((c + costs.insert * cr.ENDING[q], a + "I" * cr.ENDING[q]) for q, (c, a) in goals.items())


@pytest.mark.parametrize("costs", [cr.Costs(), cr.Costs(rerole=3, delete=7, insert=2), cr.Costs(1, 1, 1, 1)])
def test_lightest_derivation_is_the_least_of_all_repairs(costs):
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choice("suaxSUAd") for _ in range(rng.randint(1, 4)))
        assert goal(cr.lightest(symbols, cr.START, costs), costs) == every_repair(symbols, costs, 2), symbols


def in_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return con.execute(cr.OP11_SQL).fetchall()


def odd_rows(rng, n):
    texts = [None, "", " \n", "Yes.", "Yes. ", "no", "Why? \t", "è ", "end. ", "A.B!", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "student"]
    rows = []
    for conv in [None, *range(n)]:
        turns = rng.sample(range(40), rng.randint(1, 12))
        for t in turns:
            # One row a turn: DuckDB reads ties in the same order, but only by luck of equal hashes.
            rows.append((conv, None if rng.random() < 0.05 and None not in [r[1] for r in rows if r[0] == conv] else t,
                         rng.choices(roles, [8, 8, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts)))
    return rows


def test_repair_agrees_with_sql(spark):
    rows = odd_rows(random.Random(7), 150)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string").repartition(5)
    got = {r.conv_id: tuple(r) for r in cr.repaired_conversations(given).collect()}
    want = {r[0]: r for r in in_sql(rows)}
    assert len(got) == 151 and got == want


def plain(rows):
    """What the operator says about one undamaged conversation, step by step."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, symbols = set(), ""
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        c = role[:1] if role[:1] in ("s", "u", "a") and role else "x"
        symbols += "d" if not bare or (role, text) in seen else c.upper() if bare[-1] not in ".!?" else c
        seen.add((role, text))
    cost, audit = goal(cr.lightest(symbols, cr.START, cr.Costs()), cr.Costs())
    out = []
    for letter, (_, role, text) in zip(audit, rows, strict=True):
        if letter != "D":
            place = len(out) - (bool(out) and out[0][0][:1] == "s")
            out.append((role if letter == "K" else "user" if place % 2 == 0 else "assistant", text))
    return cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_one_conversation_of_many_rows_is_shared_by_tasks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(t if t % 9 else None, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "No", "So?", ""]) + f" {i % 50}" * (i % 3) + rng.choice([".", ""]))
            for i, t in enumerate(range(2500))]
    rows += [(7, "user", "Again.")] * 600  # ties and equal rows
    given = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    found = cr.repair(given.repartition(4))
    known = cr.with_duplicates(cr.described(given))
    assert cr.dealt(known).where("conv_id = 1").select("part").distinct().count() > 1
    report = {r.conv_id: r for r in found.report.collect()}
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.digests(found.rows).collect()}
    cost, audit, digest = plain(rows)
    assert (report[1].cost, report[1].audit, hashes[1]) == (cost, audit, digest)
    assert (report[2].cost, report[2].audit) == (2, "D") and 2 not in hashes
    roles = "".join(r.role[0] for r in sorted(found.rows.where("conv_id = 1").collect(), key=lambda r: r.step))
    assert SHAPE.fullmatch(roles)


def test_inserted_rows_appear_where_the_audit_has_them(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "system", "C.")], "conv_id long, turn long, role string, text string")
    found = cr.repair(rows, replace(cr.Costs(), rerole=9, delete=9, insert=1))
    assert tuple(found.report.select("cost", "audit").first()) == (10, "KIKR")
    got = [(r.role, r.text) for r in sorted(found.rows.collect(), key=lambda r: r.step)]
    assert got == [("user", "A."), ("assistant", ""), ("user", "B."), ("assistant", "C.")]


def test_crc_of_a_null_is_that_of_a_space_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, t, "user", "A.") for t in range(30)], "conv_id long, turn long, role string, text string")
    kept = {r.turn for r in cr.damaged(rows).collect()}
    assert kept == {t for t in range(30) if zlib.crc32(f" :{t}".encode()) % 20}
    none = cr.repaired_conversations(rows.limit(0))
    assert none.count() == 0
    text_ids = rows.selectExpr("cast('c' as string) as conv_id", "turn", "role", "text")
    assert cr.repaired_conversations(text_ids).first().conv_id == "c"


def test_all_rows_of_a_conversation_can_be_dropped(spark):
    turn = next(t for t in range(500) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    rows = spark.createDataFrame([(3, turn, "user", "A.")], "conv_id long, turn long, role string, text string")
    assert tuple(cr.repaired_conversations(rows).first()) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
