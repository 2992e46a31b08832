import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import common, decontaminate, packing, secret_scan, simhash, toxicity

def components(rows, most=4):
    """Smallest id reachable over fingerprints within `most` bits, by brute force."""
    root = {i: i for i, _ in rows}
    changed = True
    near = [(i, j) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= most]
    while changed:
        changed = False
        for i, j in near:
            low = min(root[i], root[j])
            if root[i] != low or root[j] != low:
                root[i] = root[j] = low
                changed = True
    return root


SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "packing"]


def test_stages_drop_what_they_judge_and_keep_the_rest(spark):
    docs = common.read_table(spark, SF, "documents")
    extra = docs.limit(1).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 3"))
    stages = dict(corpus_pipeline.STAGES)

    toxic = {r.doc_id for r in toxicity.judged(docs, common.read_table(spark, SF, "labels"), 2, 4).where("predicted = 1").collect()}
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id not in toxic)

    rows = [(r.doc_id, simhash.fingerprint((r.text or "").encode(), words=5) % 2**64) for r in docs.collect() if r.doc_id is not None]
    single = stages["near duplicates"](spark, docs, SF).collect()
    roots = components(rows)
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted({roots[i] for i, _ in rows}) and sum(r.doc_id is None for r in single) == 1

    items = [r.text for r in common.read_table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()}
    assert not {r.doc_id for r in docs.collect() if r.text and any(x in r.text for x in items)} & left
    found = {r.doc_id for r in decontaminate.contaminated(docs, common.read_table(spark, SF, "benchmark")).collect()}
    assert left == {r.doc_id for r in docs.collect()} - found

    masked = stages["secrets"](spark, docs, SF)
    assert masked.count() == docs.count()
    assert secret_scan.find_secrets(masked).where("exists(spans, s -> s.kind in (1, 2))").count() == 0


def test_run_packs_what_the_stages_keep(spark):
    docs = common.read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = packing.materialize(stage(spark, docs, SF), "stage")
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in docs.collect()}
    assert np.array_equal(got.groupby("doc_id").length.sum(), got.groupby("doc_id").doc_tokens.first())
    assert got.groupby("sequence_id").length.sum().max() <= 2048
