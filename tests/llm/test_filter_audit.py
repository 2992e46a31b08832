import itertools
import re
from collections import Counter

from tidemark.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(60))


def brute_force(docs, labels):
    """Applies every order to every document."""
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, bad in labels if i is not None and bad == 1}
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        rows.append((part or "", {x for x in fails if fails[x]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_agrees_with_applying_it(spark):
    docs = [
        (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (None, LONG, "a"), (None, None, None), (3, None, ""), (4, "", "b"),
        (5, "same " * 70, "a"), (6, LONG + " # HERE", "b"), (7, "SHOUT $" * 30, "b"), (8, "short", None), (9, LONG.upper(), "a"),
        (9, LONG.upper(), "a"), (10, LONG + " é\x1cé", "a"), (11, LONG * 300, "a"), (12, LONG + " # HERE", "a")]
    labels = [(1, 1, 0), (2, 1, 1), (5, None, 1), (6, 1, None), (9, 0, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)]
    # Names that the operator uses itself.
    rows = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, source string, mask int, words string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS part")
    got = filter_audit.filter_interactions(rows, marks).collect()
    want = brute_force(docs, labels)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want


def test_copies_without_labels_and_no_documents(spark):
    rows = spark.createDataFrame([(i, LONG, "s") for i in range(200)], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filter_audit.filter_interactions(rows, marks).collect()}
    assert got["EABCD", 1].kept == 1 and got["ABCDE", 5].removed == 199 and got["ABCDE", 5].shapley == 120 * 199
    assert filter_audit.filter_interactions(rows.limit(0), marks).count() == 0
