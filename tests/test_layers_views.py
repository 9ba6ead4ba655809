from pyspark.sql import functions as F

from tachado.functions.lexicon import load
from tachado.operators import detect, detections, layers, views

LEX = load()
GROUP = "doc_id long, cluster_id string, cat string, canonical_label string, placeholder string, surfaces array<string>"


def test_layer_fills_gaps_only(spark):
    docs = spark.createDataFrame([(1, "víctima Ana: mail ana@x.com"), (2, None)], "doc_id long, text string")
    scanned = detect.scan(docs, LEX)
    spans = F.array(F.struct(F.lit("EMPRESA").alias("cat"), F.lit("mail").alias("surface"), F.lit(13).alias("start"), F.lit(17).alias("end")), F.struct(F.lit("EMPRESA").alias("cat"), F.lit("ana@x").alias("surface"), F.lit(18).alias("start"), F.lit(23).alias("end")))
    rows = detections.mentions(layers.add_layer(scanned, spans, "model"), LEX).orderBy("ord").collect()
    assert [(r.cat, r.source_layer) for r in rows if r.start >= 13] == [("EMPRESA", "model"), ("EMAIL", "regex")]
    more = layers.add_layer(scanned, layers.pattern_layer(F.col("text")), "nlp")
    assert detections.mentions(more, LEX).where("cat = 'PERSONA'").count() == 1


def test_model_spans_are_checked(spark):
    text = "El DNI de Juan Pérez, tel +54 11 4567-8901, Zutano Fulano"
    at = lambda s: (text.index(s), text.index(s) + len(s))
    spans = [("PERSON", *at("Juan Pérez"), 0.9), ("PERSON", *at("Juan Pérez"), 0.7), ("PERSON", *at("Zutano Fulano"), 0.9), ("PHONE_NUMBER", *at("+54 11 4567-8901"), 0.75), ("DNI", *at("DNI"), 0.99), ("DNI", 0, 2, 0.99), ("PERSON", 3, 6, None)]
    df = spark.createDataFrame([(1, text, spans), (2, None, None), (3, "x", [])], "doc_id long, text string, m array<struct<entity:string,start:int,end:int,score:double>>")
    got = {r.doc_id: [(x.cat, x.surface) for x in r.s] for r in df.select("doc_id", layers.checked(F.col("text"), F.col("m"), LEX).alias("s")).collect()}
    assert got == {1: [("PERSONA", "Juan Pérez"), ("TELEFONO", "+54 11 4567-8901")], 2: [], 3: []}


def test_views(spark):
    d = spark.createDataFrame([(1, 0, "PERSONA", "Juan Pérez", None), (1, 1, "PERSONA", "PEREZ JUAN", None), (1, 2, "DNI", "20.123.456", None), (1, 3, "DNI", "20123456", "g"), (1, 4, "PERSONA", "Otra Cosa", None)], "doc_id long, id int, cat string, original string, cluster_id string")
    assert [(r.a, r.b) for r in views.similar(d).orderBy("a").collect()] == [(0, 1), (2, 3)]
    g = spark.createDataFrame([(1, "g", "PERSONA", "[PERSONA_1]", "[PERSONA_1]", ["Juan", "juan pérez"]), (1, "h", "DNI", "Cédula", None, []), (1, "i", "EMAIL", None, None, [])], GROUP)
    assert sorted((r.cluster_id, r.id) for r in views.available(d, g).collect()) == [("g", 1), ("g", 2), ("g", 4), ("h", 2)]
    assert {r.cluster_id: r.label for r in views.labelled(g).collect()} == {"g": "juan pérez", "h": "Cédula", "i": "i"}
    assert [r.cluster_id for r in views.filtered(g, " PÉREZ").collect()] == ["g"]
    assert sorted((r.source, r.target) for r in views.merge_candidates(g).collect()) == [("g", "h"), ("g", "i"), ("h", "g"), ("i", "g")]
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in views.summary(docs, d, g).orderBy("doc_id").collect()] == [(1, 3, 5, 3), (2, 0, 0, 0)]
