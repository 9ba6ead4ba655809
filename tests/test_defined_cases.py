"""Nulls, empty tables, ties, repeated rows and clashing names, operator by operator."""

from pyspark.sql import functions as F

from tachado import queries
from tachado.functions.lexicon import load
from tachado.operators import anonymize, detect, detections, intervals, pairs, resolve, review, search, views
from tachado.plans import analysis
from tachado.sinks import export
from tachado.sources import documents as ingest
from tachado.streaming.stream import anonymize_stream

LEX = load()
SPAN = "array<struct<start:int,end:int,n:int>>"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_empty_tables_give_empty_ones(spark):
    empty = docs(spark)
    a = analysis.analyze(empty)
    for df in (a.mentions, a.detections, a.edges, a.clusters, a.statistics, a.anonymized, anonymize_stream(empty), search.search(empty, "x")):
        assert df.count() == 0
    d = detections.detections(a.mentions.drop("row"))
    for df in (d, detections.prune(d, LEX), detections.statistics(d), detections.equivalences(d), anonymize.places(d), anonymize.highlights(d), export.csv_documents(d), views.similar(d)):
        assert df.count() == 0
    links = resolve.edges(a.mentions, LEX)
    assert links.count() == resolve.groups(a.mentions, LEX).count() == resolve.clusters(a.mentions, links).count() == 0
    log = spark.createDataFrame([], "doc_id long, seq long, action string, args map<string,string>")
    assert review.replay(empty, d, a.mentions, resolve.clusters(a.mentions, links), log).count() == 0
    assert ingest.pages_to_documents(spark.createDataFrame([], "doc_id long, page int, text string")).count() == 0


def test_intervals(spark):
    rows = [(1, [(0, 5, 1), (0, 5, 2), (5, 5, 3), (3, 9, 4)]), (2, []), (3, None), (4, [(None, 3, 1), (1, 2, 2)])]
    df = spark.createDataFrame(rows, f"k int, s {SPAN}")
    got = {r.k: r for r in df.select("k", intervals.pack(F.col("s"), SPAN).alias("p"), intervals.sweep(F.col("s"), SPAN).alias("w")).collect()}
    assert [x.n for x in got[1].p] == [1, 3] and [x.n for x in got[1].w] == [1, 3]
    assert got[2].p == [] and got[3].p is None and got[3].w is None and [x.n for x in got[4].p] == [1, 2]
    flat = spark.createDataFrame([(None, 0, 2), (None, 1, 4), (1, 5, 6), (1, 5, 6)], "k int, start int, end int")
    assert sorted(map(tuple, intervals.merge(flat, ["k"]).collect()), key=str) == [(1, 5, 6), (None, 0, 4)]


def test_nulls_and_repeats(spark):
    rows = [(1, "a@b.cc y A@B.CC"), (1, "a@b.cc y A@B.CC"), (None, "c@d.ee"), (2, None), (3, ""), (4, "x" * 100_000 + " z@z.zz")]
    a = analysis.analyze(docs(spark, *rows))
    assert sorted(((r.doc_id, r.anonymized_text and r.anonymized_text[-12:]) for r in a.anonymized.collect()), key=str) == sorted(
        [(1, " y [EMAIL_1]")] * 2 + [(None, "[EMAIL_1]"), (2, None), (3, ""), (4, "xx [EMAIL_1]")], key=str
    )
    assert a.statistics.count() == 4 and {r.EMAIL for r in a.statistics.collect()} == {1}
    # Rows of one key are one document to the table forms.
    found = a.mentions.where("doc_id is not null").drop("row")
    assert {(r.doc_id, r.id, r.placeholder) for r in detections.detections(found).collect()} == {(1, 0, "[EMAIL_1]"), (4, 0, "[EMAIL_1]")}
    assert detections.mentions(detect.scan(docs(spark, (None, None)), LEX), LEX).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "x", "y", 3, "t")], "doc_id long, body string, text string, hits string, row int, key string")
    a = analysis.analyze(df, text="body")
    assert a.anonymized.first().anonymized_text == "[EMAIL_1]"
    out = anonymize.anonymize(df, a.detections, text="body").first()
    assert (out.anonymized_text, out.text, out.hits, out.row, out.key) == ("[EMAIL_1]", "x", "y", 3, "t")


def test_links_of_odd_mentions(spark):
    rows = [(1, 0, "m0", "PERSONA", None, 0), (1, 1, "m1", "PERSONA", "", 5), (1, 2, "m2", "PERSONA", "Ana Pérez", 5), (1, 3, "m3", "PERSONA", "Ana Pérez", 5), (None, 0, "m0", "DNI", "1", 0)]
    m = spark.createDataFrame(rows, "doc_id long, ord int, mention_id string, cat string, surface string, start int")
    assert sorted((r.src, r.dst, r.reason) for r in resolve.edges(m, LEX).collect()) == [(0, 1, "exact"), (2, 3, "exact")]
    assert [r.surfaces for r in resolve.groups(m, LEX).collect()] == [["Ana Pérez"]]


def test_many_names_link_fast():
    import time

    m = [{"ord": i, "mention_id": f"m{i}", "cat": "EMPRESA", "surface": f"Aceros {i:04d} SA", "start": i, "norm": f"aceros {i:04d} sa", "tokens": [], "surnames": []} for i in range(600)]
    began = time.time()
    links = resolve.links_of(m)
    assert len(links) > 1000 and time.time() - began < 20


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, "segundo texto largo,"), (1, 1, None), (1, 2, "segundo texto largo,"), (None, 1, "sin clave pero con texto"), (2, 1, " \n"), (3, 1, "corto")], "doc_id long, page int, text string")
    got = {r.doc_id: (r.text, r.status) for r in ingest.pages_to_documents(pages).collect()}
    assert got[1] == ("segundo texto largo,\n\nsegundo texto largo,", "ok") and got[2] == ("", "no_text") and got[3] == ("corto", "too_short") and got[None][1] == "ok"


def test_scored_pairs_score_each_pair_of_texts_once(spark, monkeypatch):
    """Copies, chunks of a class, repeated keys and nulls against brute force; a text's copies cost no further scores."""
    monkeypatch.setattr(pairs, "CHUNK", 3)
    rows = [(i, i % 2, f"t{i % 3}") for i in range(40)] + [(7, 1, "t1"), (50, 0, None), (51, 0, ""), (None, 0, "t1"), (52, None, "t1")]
    scored = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def score(x, y):
        scored.add(1)
        return len(x) + len(y)

    df = spark.createDataFrame(rows, "k long, b long, t string")
    got = sorted(tuple(r) for r in pairs.scored_pairs(df, "k", ["b"], "t", score).collect())
    good = [(k, b, t or "") for k, b, t in rows if k is not None and b is not None]
    want = sorted((k, m, len(t) + len(u)) for k, b, t in good for m, c, u in good if b == c and k < m)
    assert got == want and scored.value < len(want) / 2
    assert pairs.scored_pairs(df.limit(0), "k", ["b"], "t", score).count() == 0


def test_fuzzy_pairs_are_scored_by_classes(spark, tmp_path):
    """2,000 customers of one block have 1,999,000 pairs, but 97 codes: batches of their pairs of codes go to Python, not of the pairs."""
    spark.range(2000).selectExpr("id as c_custkey", "1 as c_nationkey", "10.0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    df = queries.fuzzy_pairs(spark, str(tmp_path))
    assert df.count() == 2000 * 1999 // 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("ArrowEvalPython")
