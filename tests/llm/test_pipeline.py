"""The pipeline's stages against plain versions on the small tables."""
import os

import pytest

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables not present")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from chorale.llm import simhash

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    kept = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, kept[-1], ROOT).write.parquet(path)
        kept.append(spark.read.parquet(path))
        if i < 4:
            assert kept[-1].columns == docs.columns
    _, good, clean, single, cut, packed = kept
    labels = {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in (docs, good, clean, single, cut)]
    wrong = sum((d in ids[1]) != bool(labels[d].quality) for d in ids[0] & labels.keys())
    assert wrong <= 0.05 * len(labels) and sum((d in ids[2]) == bool(labels[d].toxic) for d in ids[1] & labels.keys()) <= 0.1 * len(labels)
    groups = simhash.cluster(clean).collect()
    assert ids[3] == {r.component_id for r in groups} and ids[4] == ids[3]
    # no passage of 13 words is left in two documents
    seen = {}
    before = {r.doc_id: r.text.encode().split() for r in single.collect()}
    for d in sorted(before):
        w = before[d]
        gone = set()
        for i in range(len(w) - 12):
            if seen.setdefault(tuple(w[i : i + 13]), d) < d:
                gone |= set(range(i, i + 13))
        before[d] = b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert {r.doc_id: b" ".join(r.text.encode().split()) for r in cut.collect()} == before
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[4]


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables not present")
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_exact_topk", "op8_embedding_dedup", "op10_suffix_dedup"])
def test_query_agrees_with_sql(spark, name):
    from chorale.llm.queries import LLM_ORACLES, LLM_QUERIES
    from oracle import duck, rows_of

    got, want = LLM_QUERIES[name](spark, ROOT), duck(ROOT).sql(LLM_ORACLES[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
