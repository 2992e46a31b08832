import math
import random
import re
import uuid
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tidemark import session
from tidemark.llm import language, pitman_yor

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Pitman-Yor

def test_arrays_survive_packing():
    arrays = [np.arange(1000, dtype="<u8") ** 3, np.empty(0, "<u4"), np.array([-1.5, 2.0], "<f4"), np.array([1], "u1")]
    for a, b in zip(arrays, pitman_yor.unpacked(pitman_yor.packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_table_counts_follow_the_exact_distribution():
    discount, weight, customers = 0.6, 0.7, 4

    def seat(k, tables):  # all seatings of the customers left, each with its weight
        if k == customers:
            return Counter({len(tables): 1.0})
        out = Counter()
        for i, n in enumerate(tables):
            for t, w in seat(k + 1, [*tables[:i], n + 1, *tables[i + 1 :]]).items():
                out[t] += w * (n - discount)
        for t, w in seat(k + 1, [*tables, 1]).items():
            out[t] += w * weight
        return out

    want = seat(0, [])
    n = 40_000
    rng = np.random.default_rng(0)
    got = pitman_yor.draw_tables(np.full(n, customers), np.full(n, weight), discount, pitman_yor.log_stirling(pitman_yor.EXACT, discount), rng)
    for t in range(1, customers + 1):
        assert (got == t).mean() == pytest.approx(want[t] / sum(want.values()), abs=0.01)
    big = pitman_yor.draw_tables(np.array([0, 1, 5000, 5000]), np.array([1.0, 1.0, 1e-9, 1e9]), discount, pitman_yor.log_stirling(pitman_yor.EXACT, discount), rng)
    assert big[:2].tolist() == [0, 1] and big[2] < 10 and big[3] > 4990


def test_many_customers_follow_the_same_distribution():
    n, rng = 4000, np.random.default_rng(3)
    for discount, customers, weight in ((0.8, 65, 5.0), (0.8, 200, 50.0), (0.8, 2000, 0.5), (0.8, 2000, 5.0), (0.8, 2000, 50.0), (0.8, 2000, 2000.0), (0.7, 1000, 3.0)):
        table = pitman_yor.log_stirling(customers, discount)
        t = np.arange(1, customers + 1)
        logs = table[customers, 1:] + t * np.log(weight)
        chance = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        mean = (chance * t).sum()
        spread = math.sqrt((chance * t * t).sum() - mean**2)
        got = pitman_yor.draw_tables(np.full(n, customers), np.full(n, weight), discount, table[: pitman_yor.EXACT + 1, : pitman_yor.EXACT + 1], rng)
        assert got.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(n))
        assert got.std() == pytest.approx(spread, rel=0.08)


def test_base_scores_match_brute_force_and_the_model_is_better(spark):
    pick = random.Random(7)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [" ".join(x for _ in range(pick.randrange(1, 40)) for x in (pick.choice(nouns[:20]), pick.choice(verbs[:20]))) for _ in range(300)]
    texts += [None, "", " \n", "A b\x0bC  é É", "the " * 8000, "never seen before"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t, _ in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _, _ in rows]
    count = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(count.values()), len(count)
    got = pitman_yor.score_texts(docs, 2, 7, buckets=5).collect()
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    want = [(i, h, len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)) for (i, _, _), h, x in zip(rows, held, tokens)]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a.perplexity == pytest.approx(10 ** (-a.score / a.n_tokens), rel=1e-6)
    fresh = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    one = {(str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in pitman_yor.score_texts(docs, 2, 7, buckets=1).collect()}
    assert {(a, b) for a, b, _ in one} == {(str(r.doc_id), r.n_tokens) for r in got}
    assert pitman_yor.score_texts(docs.limit(0), 2, 7).count() == 0
    assert {r.train_tokens for r in pitman_yor.score_texts(docs, 0, 1).collect()} == {0}


def test_slices_of_texts_count_as_whole_texts():
    texts = pa.array(["First é text " * 9, "SECOND Text", "a B", "Text ü first"])
    part = texts.slice(1, 3).cast(pa.large_string())
    for a, b in zip(pitman_yor.batch_pairs(part, np.ones(3), None), pitman_yor.batch_pairs(pa.array(part.to_pylist(), pa.large_string()), np.ones(3), None), strict=True):
        assert a.tolist() == b.tolist()
    assert len(pitman_yor.batch_pairs(part, np.ones(3), None)[0]) == len({"second", "text", "a", "b", "ü", "first", None})


def test_every_word_is_a_context_of_its_own(spark):
    pick, n = random.Random(9), 3000
    after = [pick.sample(range(n), 1)[0] for _ in range(n)]

    def walk(k):
        at, out = pick.randrange(n), []
        for _ in range(k):
            out.append(f"w{at}")
            at = after[at] if pick.random() < 0.9 else pick.randrange(n)
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk(120)) for i in range(1500)], "doc_id long, text string").repartition(3)

    def bits(model):
        rows = pitman_yor.score_texts(docs, 2, 7, model, buckets=3).where("held_out").collect()
        return -sum(r.score for r in rows) / sum(r.n_tokens for r in rows)

    # a tenth of the words is free, the others follow from the word before; a class mixes a dozen words
    assert pitman_yor.Model().classes is None
    assert bits(None) < 0.8 < 1.0 < bits(pitman_yor.Model(classes=256))


def test_draws_repeat(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 80), i -> concat('w', cast((id * i) % 13 as string)))) as text")
    a, b = (sorted(map(tuple, pitman_yor.score_texts(docs, 2, 7, buckets=3).collect())) for _ in range(2))
    assert a == b


def test_sweeps_leave_two_states_and_no_copy_of_the_pairs(spark, tmp_path, monkeypatch):
    docs = spark.range(60).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', cast((id * i) % 501 as string)))) as text")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    for module in (session, pitman_yor):
        monkeypatch.setattr(module, "shared_folder", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}", raising=False)
    got = pitman_yor.score_texts(docs, 2, 7, pitman_yor.Model(sweeps=5, averaged=3), buckets=3)
    size = {p.name[:-33]: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in tmp_path.iterdir()}
    assert len(list(tmp_path.glob("pitman-yor-seats-*"))) == 2 and "pitman-yor-pairs" not in size
    assert size["pitman-yor-seats"] < size["pitman-yor-buckets"]
    assert got.count() == 60 and spark.conf.get(name) == before


def test_probabilities_of_a_context_sum_to_one():
    texts = pa.array(["a b a c a b", "b a", "c a b b"], pa.large_string())
    words, per_word, context, counts, _, _ = pitman_yor.batch_pairs(texts, np.ones(3), 4)
    full = np.repeat(np.arange(len(words)), 5), np.tile(np.arange(5), len(words))
    known = dict(zip(zip(np.repeat(np.arange(len(words)), per_word).tolist(), context.tolist()), counts.tolist()))
    table = np.array([known.get(x, 0) for x in zip(*(f.tolist() for f in full))], "<u8")
    model = pitman_yor.Model(classes=4)
    seats = pitman_yor.Restaurants(pitman_yor.packed(np.full(len(words), 5, "<u4"), full[1].astype("<u2"), table), 0, model)

    def totals():
        customers, tables = np.zeros(5, int), np.zeros(5, int)
        np.add.at(customers, seats.context, seats.counts)
        np.add.at(tables, seats.context, seats.tables)
        return pitman_yor.Totals(customers, tables, int(seats.parent_customers.sum()), int(seats.parent_tables.sum()), int(table.sum()), len(words))

    for turn in range(3):
        now = totals()
        unknown = (model.parent_strength + model.parent_discount * now.parent_tables) / (now.known + 1) / (model.parent_strength + now.parent_customers)
        back = (model.strength + model.discount * now.tables) / (model.strength + now.customers)
        got = np.bincount(seats.context, seats.predictive(now), 5) + back * unknown
        assert got == pytest.approx(np.ones(5))
        seats.sweep(turn, now)


# Language

def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    sizes, k = np.array([1, 4, 3]), 3
    begin = np.cumsum(sizes) - sizes
    scores, moves, first = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, expected, log_z = language.Chains.of(begin, sizes).marginals(scores, moves, first, counts=True)
    want, pairs, total = np.zeros((8, k)), np.zeros((k, k)), 0.0
    for b, n in zip(begin, sizes):
        paths = {p: math.exp(first[p[0]] + sum(scores[b + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in product(range(k), repeat=int(n))}
        z = sum(paths.values())
        total += math.log(z)
        for p, w in paths.items():
            for i, y in enumerate(p):
                want[b + i, y] += w / z
            for x, y in zip(p, p[1:]):
                pairs[x, y] += w / z
    assert got == pytest.approx(want) and expected == pytest.approx(pairs) and log_z == pytest.approx(total)


def test_words_are_told_apart_in_mixed_texts(spark):
    pick = random.Random(8)
    ends = {"aa": ["ing", "tion", "the"], "bb": ["keit", "ung", "sch"], "cc": ["mente", "ción", "dos"]}
    word = lambda lang: "".join(pick.choice("bdfgklmnprst") + pick.choice("aeiou") for _ in range(2)) + pick.choice(ends[lang])
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    texts = [("\n".join(line(lang, pick.randrange(3, 15)) for _ in range(4)), lang) for lang in ends for _ in range(60)]
    rows = [(i, t, lang, 0.5) for i, (t, lang) in enumerate(texts)]
    rows += [(None, "xyz", "aa", 0.5), (1000, None, "aa", 0.5), (1001, "", "bb", 0.5), (1002, "12 | 3", None, 0.5), (1003, line("bb", 5000), None, 0.5), (3, texts[3][0], "aa", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    held = (language.common.crc_of("doc_id") % 3) == 1
    field = language.train(docs, ~held, steps=30)
    assert field.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.predicted(docs, field).collect()}
    fresh = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == texts[i][1] for i in fresh) >= 0.97 * len(fresh) and got[1003].lang_pred == "bb"
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    chance, named, _ = language.word_languages(field, pa.array([" ".join(line(x, 12) for x in ("aa", "cc", "aa"))]))
    labels = [field.languages[i] for i in chance.argmax(axis=1)]
    assert sum(a == b for a, b in zip(labels, ["aa"] * 12 + ["cc"] * 12 + ["aa"] * 12)) >= 33 and named.all()
    none = language.train(docs.limit(0), ~held)
    assert {r.lang_pred for r in language.predicted(docs, none).collect()} == {"und"}
    assert language.predicted(docs.limit(0), field).count() == 0
