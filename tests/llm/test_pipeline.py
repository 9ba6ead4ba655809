from collections import Counter

import corpus_pipeline
from tachado.llm import simhash

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "source mixing", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if k == 0:
            right = sum((i in after) == bool(labels[i]) for i in labels if i in before)
            assert right >= 0.95 * sum(i in before for i in labels) and len(after) < len(before)
        if k == 1:
            groups = simhash.near_duplicates(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
            assert set(after) == {r.component_id for r in groups.collect()}
        if k != 2:
            assert all(after[i] == before[i] for i in after)
    pieces = corpus_pipeline.packing_stage(spark, docs, DIR).collect()
    assert {p.doc_id for p in pieces} == set(after) and set(after) <= set(seen)
    load = Counter()
    for p in pieces:
        load[p.sequence_id] += p.length
    assert max(load.values()) <= 4096


def test_run_equals_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    got = corpus_pipeline.run(spark, DIR)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(docs)


def test_odd_rows_pass_the_stages(spark):
    rows = [(1, None, None, None, None), (None, "some words here", "en", "src1", 3), (2, "", "en", "x", 0), (2, "", "en", "x", 0), (3, "w " * 5000, None, "src2", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, epoch string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns[-1] == "epoch"
        docs.collect()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DIR) if "text" in empty.columns else empty
        assert empty.count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two"))
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, DIR)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, a), (7, b)]
