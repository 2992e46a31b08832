import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tidemark.llm import simhash
from tidemark.llm.components import connected_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_definition(spark):
    texts = [None, "", " \n", "one", "One TWO three", "a b c d", "a b c d e f g h", "a b c d " * 5000, "é\x1cé x\x0by z w", "A b\tc  d\re"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(rows).collect()}
    assert got == {i: plain_fingerprint(t or "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [4096, 60])
def test_links_connect_all_pairs_within_four_bits(spark, block):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for centre in prints[:20]:
        x = centre
        for _ in range(15):
            y = x
            for j in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                y ^= 1 << j
            prints.append(y)
            x = y if rng.random() < 0.5 else centre
    prints += [prints[0] ^ int(m) for m in rng.integers(0, 2**11, 400)]
    prints = sorted(set(prints))
    a = np.array(prints, np.uint64)
    near = [(prints[i], prints[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if j > i]
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long").repartition(3)
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.similar_fingerprints(rows, 4, block).collect()]
    assert set(map(tuple, map(sorted, links))) <= set(near)
    assert roots(prints, links) == roots(prints, near)


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for x in links for n in x}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_of_a_group_share_the_smallest_doc_id(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest " * 20
    texts = [(9, base), (4, base), (7, base + "end"), (4, base), (None, base), (11, None), (2, ""), (30, "other words that stand alone here today")]
    rows = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, component_id int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()]
    assert sorted(got, key=str) == sorted([(9, 4), (4, 4), (7, 4), (4, 4), (None, 4), (11, 2), (2, 2), (30, 30)], key=str)
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
