import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import substring_dedup as sd

SMALL = sd.Sizes(length=40, head=8, block=8)


def brute_force(texts, length):
    """Marks every byte of every window that starts twice or more."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for p in range(len(d) - length + 1):
            if starts[d[p : p + length]] > 1:
                gone[p + 1 : p + length + 1] = 1
        runs = int((np.diff(gone) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng, n, words):
    """Texts that share passages of every length around the limit, at their starts, inside and at their ends."""
    vocabulary = [f"{rng.choice('abcdefgh')}{i}" for i in range(words)]
    common = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))))
            if rng.random() < 0.7:
                c = rng.choice(common)
                a = rng.randint(0, len(c) - 30)
                parts.append(c[a : a + rng.randint(20, 80)])
        texts.append((rng.choice(["", " "])).join(parts))
    return texts


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_removed_bytes_are_those_of_brute_force(spark, batches):
    rng = random.Random(batches)
    texts = passages(rng, 120, 3000) + passages(rng, 40, 12)
    texts += [None, "", "x" * 39, "x" * 40, "y" * 41, "z" * 200, "ab" * 150, "abc" * 90, texts[3], texts[3], texts[5] * 3]
    texts += ["é日本" * 40, "é日本" * 12 + "ü", "k" + "é日本" * 30]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file long, head string").repartition(6)
    got = {r.doc_id: tuple(r)[1:] for r in sd.without_repeats(docs, batches, SMALL).collect()}
    want = brute_force(texts, 40)
    assert got == dict(enumerate(want))


def test_rows_that_share_an_id_and_bytes_left(spark):
    a, b = "one two three four five six seven eight nine ten", "other words that nobody repeats anywhere at all here"
    texts = [(None, a), (None, b), (1, a + " and more"), (2, b[:30]), (2, b[:30])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((str(r.doc_id), bytes(r.kept).decode(), r.n_spans) for r in sd.without_repeats(docs, 2, SMALL, with_text=True).collect())
    assert got == sorted([("None", "", 1), ("None", b, 0), ("1", " and more", 1), ("2", b[:30], 0), ("2", b[:30], 0)])
    assert sd.without_repeats(docs.limit(0), 2, SMALL).count() == 0


def test_many_copies_and_a_common_passage_with_different_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(9))
    texts = [" ".join(word() for _ in range(rng.randint(0, 8))) + rng.choice("!?.") + passage[rng.randint(0, 20) : rng.randint(45, 62)] + word() for _ in range(400)]
    texts += ["copy of a text that is here many times over and over"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in sd.without_repeats(docs, 3, SMALL).collect()}
    assert got == dict(enumerate(brute_force(texts, 40)))


def test_windows_belong_to_one_anchor_also_across_strides(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    monkeypatch.setattr(sd, "STRIDE_BITS", 9)
    sd.powers.cache_clear()
    runs = [x for found in sd.text_anchors(data, SMALL) for x in zip(*found, strict=True)]
    sd.powers.cache_clear()
    owned = sorted(p for _, _, _, first, last in runs for p in range(first, last + 1))
    assert owned == list(range(5000 - 40 + 1))
    assert all(first <= last and last <= at <= first + 40 - 8 for _, _, at, first, last in runs)


def test_levels_double_and_replace_each_other(spark):
    schema = "head long, cover long, file long, place long, shape int"
    family = sd.Family()
    sizes = []
    for k in range(7):
        family.add(spark.createDataFrame([(100 + k // 2, k, 1, k, 0)], schema))
        sizes.append([s for s, _, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    assert sorted(r.head for r in family.repeated().collect()) == [100, 100, 101, 101, 102, 102]
