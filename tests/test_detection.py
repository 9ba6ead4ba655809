import re

import pytest
from pyspark.sql import functions as F

from tachado.functions import text as T
from tachado.functions.fuzzy import token_sort_ratio
from tachado.functions.lexicon import load
from tachado.operators import anonymize, detect, detections, filters, resolve, scan, search
from tachado.plans.analysis import analyze

LEX = load()


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return detections.mentions(detect.scan(docs, LEX), LEX).orderBy("doc_id", "ord").collect()


def check(spark, cat, surface, text=None, start=0):
    text = surface if text is None else text
    df = spark.createDataFrame([(cat, surface, text[max(0, start - 120) : start], text[start : start + 180])], "cat string, s string, l string, r string")
    return df.select(filters.valid(F.col("cat"), F.col("s"), F.col("l"), F.col("r"), LEX)).first()[0]


@pytest.mark.parametrize(
    "cat, surface, good",
    [
        ("PATENTE", "Ley 471", False), ("PATENTE", "Art 123", False), ("PATENTE", "AB 123 CD", True), ("PATENTE", "ABC-123", True),
        ("ORGANISMO", "Tribunal Superior quien revise", False), ("ORGANISMO", "Juzgado Civil nro", False), ("ORGANISMO", "Juzgado Civil 4", True),
        ("PERSONA", "Carrera Municipal", False), ("PERSONA", "Daniel Carrera", True), ("PERSONA", "manifiesta que vio", False), ("PERSONA", "Ana de Luca", False),
        ("TELEFONO", "4567-8901", False), ("TELEFONO", "+54 11 4567-8901", True), ("EXPEDIENTE", "nombre", False), ("EXPEDIENTE", "EXP 123/2020", True),
        ("DOMICILIO", "calle que se encuentren", False), ("DOMICILIO", "calle San Martín 123", True), ("EMAIL", "a@b.co", True), ("EMAIL", "a", False),
    ],
)
def test_validity(spark, cat, surface, good):
    assert check(spark, cat, surface) is good


def test_money_and_identity_contexts(spark):
    text = "la suma de 12.345.678"
    assert not check(spark, "DNI", "12.345.678", text, 11)
    text = "condena. DNI 12.345.678"
    assert check(spark, "DNI", "12.345.678", text, 13)
    assert check(spark, "OTRO", "AB123456", "pasaporte AB123456", 10) and not check(spark, "OTRO", "AB123456")


def test_layers_and_offsets(spark):
    text = "EXP 12345/2020. CUIT 20-12345678-6; correo: ana@x.com.ar; Dra. YAMILA MONICA; «ñandú» tel +54 9 11 4567-8901."
    rows = found(spark, text)
    assert {r.cat for r in rows} >= {"EXPEDIENTE", "CUIT", "EMAIL", "TELEFONO", "PERSONA"}
    assert all(text[r.start : r.end].strip() == r.surface for r in rows)
    assert all(a.end <= b.start for a, b in zip(rows, rows[1:], strict=False))


def test_invalid_check_digit_is_no_cuit(spark):
    assert not [r for r in found(spark, "CUIT 20-12345678-9") if r.cat == "CUIT"]


def test_nulls_empty_and_long(spark):
    assert found(spark, None, "", " \n") == []
    assert len(found(spark, "ana@x.com " * 3000)) == 3000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert analyze(empty).statistics.count() == 0


def test_name_cleaning():
    s = detect.Scanner(LEX, [])
    assert s._name("c/ Juan Pérez", 0) == ("Juan Pérez", 3)
    assert s._name("ORIGINAL Ana Gómez", 5) == ("Ana Gómez", 14)
    assert s._name("Acierta Silvia Gomez", 0) == ("Silvia Gomez", 8)


def test_ranges_pack():
    t = detect.Taken()
    assert [t.add(*r) for r in [(5, 9), (0, 5), (8, 12), (9, 12), (1, 2)]] == [True, True, False, True, False]
    assert detect.merged([(0, 4), (6, 9), (12, 13)], 2) == [(0, 9), (12, 13)]


def test_native_spans_equal_python(spark):
    texts = ["Añá bé, cde 😀 x@y.zz  A1", "", None, "éé é\nzz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in (r"\w+", r"[a-zé]{2}", r"\b\d"):
        got = {r.i: [(s.start, s.end, s.raw) for s in r.s] for r in df.select("i", scan.spans(F.col("t"), pattern).alias("s")).collect()}
        assert got == {i: [(*m.span(), m[0]) for m in re.finditer(pattern, t or "")] for i, t in enumerate(texts)}


def test_accent_blind_search(spark):
    df = spark.createDataFrame([(1, "El PÉREZ y perez; Perèz")], "doc_id long, text string")
    assert [(r.start, r.raw) for r in search.search(df, "pérez").orderBy("start").collect()] == [(3, "PÉREZ"), (11, "perez"), (18, "Perèz")]


def test_prune_and_substitution(spark):
    text = "Sra. Mariana Bressan. Mariana Bressan con Mariana Bressan Gómez"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nada")], "doc_id long, text string")
    a = analyze(docs)
    out = {r.doc_id: r.anonymized_text for r in a.anonymized.collect()}
    assert out[2] is None and out[3] == "nada" and "[PERSONA_" in out[1]
    rows = a.detections.collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == list(range(len(rows)))


def test_documents_without_a_key_or_of_one_key_are_told_apart(spark):
    rows = [(None, "mail ana@x.com.ar fin"), (None, "texto sin nada personal aqui"), (1, "correo luis@y.com"), (1, "texto sin nada personal aqui"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(2)
    a = analyze(docs)
    got = sorted(((r.doc_id, r.anonymized_text) for r in a.anonymized.collect()), key=str)
    want = [(None, "mail [EMAIL_1] fin"), (None, "texto sin nada personal aqui"), (1, "correo [EMAIL_1]"), (1, "texto sin nada personal aqui"), (2, None), (3, "")]
    assert got == sorted(want, key=str)
    assert sorted(((r.doc_id, r.original) for r in a.detections.collect()), key=str) == [(1, "luis@y.com"), (None, "ana@x.com.ar")]
    # Matched by key, what can't be told apart is withheld, never given in clear.
    out = sorted(((r.doc_id, r.anonymized_text) for r in anonymize.anonymize(docs, a.detections).collect()), key=str)
    assert out == sorted([(None, None), (None, None), (1, "correo [EMAIL_1]"), (1, None), (2, None), (3, "")], key=str)


def test_analysis_moves_no_text(spark):
    from tachado import queries

    text = queries.document_analysis(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "hashpartitioning" not in text


def test_row_and_table_forms_agree(spark):
    texts = ["Sra. Mariana Bressan. Mariana Bressan con Mariana Bressan Gómez y Ana; mail a@b.cc, A@B.CC", "Pedro Álvarez (DNI 12.345.678) y Pedro Álvarez Gómez. Ana Sosa", "nada", None, "EXP 12345/2020 y exp 12345/2020"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = ["doc_id", "id", "cat", "original", "placeholder", "positions", "mention_ids", "left", "right"]
    for mode in ("cat", "gen", "ini"):
        row = sorted(map(str, analyze(docs, mode=mode).detections.select(*cols).collect()))
        m = detections.mentions(detect.scan(docs, LEX), LEX)
        assert row == sorted(map(str, detections.prune(detections.detections(m, mode=mode), LEX).select(*cols).collect()))


def test_literals_leave_no_match_out():
    """Scanning only texts that hold a pattern's literals gives the same spans, whatever the case and its odd letters."""
    import duckdb

    from tachado import cases
    from tachado.operators import catalog
    from tachado.operators.literals import fold, may_match, needed

    guarded, all_of = (detect.Scanner(LEX, catalog.load()) for _ in "ab")
    all_of.needed = dict.fromkeys(all_of.needed, ())
    texts = [r[2] for r in duckdb.sql(cases.texts("(SELECT range AS k0 FROM range(400))", "k0", cases.CASES)).fetchall()]
    texts += [t.upper() for t in texts] + [t.replace("s", "ſ").replace("i", "ı") for t in texts] + ["KIOSCO llamado Luna", "İmputado Juan Pérez"]
    assert all(guarded.spans(t) == all_of.spans(t) for t in texts)
    assert set(needed(re.compile(r"(?:hello|x+yz)\d"))) == {"hello", "yz"}
    assert needed(re.compile(r"\d+")) == () and needed(re.compile(r"(?:a|\d)")) == () and not may_match(("q",), fold("abc"))


def test_bad_catalog_pattern_is_left_out_with_a_warning(spark, tmp_path):
    import json

    path = tmp_path / "catalog.json"
    path.write_text(json.dumps([{"nombre_entidad": "RGX_URL", "regex": "(["}, {"nombre_entidad": "RGX_EMAIL", "regex": "x+@x+", "score": 0.5}, {"nombre_entidad": "RGX_IP", "regex": "a", "activa": False}]))
    from tachado.operators import catalog

    with pytest.warns(UserWarning, match="left out"):
        assert [r[2] for r in catalog.load(str(path))] == ["x+@x+"]
        docs = spark.createDataFrame([(1, "ver xx@xx hoy")], "doc_id long, text string")
        hits = detect.scan(docs, LEX, catalog=str(path)).first().hits
    assert [h.surface for h in hits] == ["xx@xx"]


def test_full_dictionary_folder(tmp_path):
    (tmp_path / "nombres.json").write_text('["zutano"]')
    (tmp_path / "apellidos.json").write_text('["fulano", "mengano"]')
    lex = load(str(tmp_path))
    assert lex.names == {"zutano", "fulano", "mengano"} and lex.formulas == frozenset()
    assert detect.Scanner(lex, []).spans("firma Zutano Fulano hoy")[0]["surface"] == "Zutano Fulano" and not detect.Scanner(LEX, []).spans("firma Zutano Fulano hoy")


def test_work_folder_is_shared_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tachado.plans import work

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        work.work_dir(fake)


def test_overlaps_are_replaced_back_to_front(spark):
    df = spark.sql("select 'abcdef' t, array(named_struct('start', 1, 'end', 3, 'placeholder', 'X'), named_struct('start', 4, 'end', 6, 'placeholder', 'YY')) s")
    assert df.select(anonymize.substitute(F.col("t"), F.col("s"))).first()[0] == "aXdYY"


def brute_ratio(a, b):
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return 100.0 if x == y else 200.0 * row[-1] / (len(x) + len(y))


def test_token_sort_ratio(spark):
    pairs = [("juan perez", "perez juan"), ("marta gomez", "marta gomes"), ("a", "b"), ("", "x"), ("ferreyra ana", "ana ferreira"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", token_sort_ratio(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert abs(r.s - brute_ratio(r.a, r.b)) < 1e-9


def test_links_and_groups(spark):
    text = "Juan Carlos Pérez, DNI 20.123.456. J. C. Pérez vino. Sandra Villarreal y luego Cristian Villarreal. Ana Ferreyra; Ana Ferreira."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lex = load()
    m = detections.mentions(detect.scan(docs, lex), lex)
    groups = [set(r.surfaces) for r in resolve.clusters(m, resolve.edges(m, lex)).collect()]
    assert not any({"Sandra Villarreal", "Cristian Villarreal"} <= g for g in groups)


def test_surnames_meet_in_both_orders(spark):
    df = spark.createDataFrame([("castro alicia carina", "alicia carina castro")], "a string, b string")
    r = df.select(*(T.surnames(T.name_tokens(F.col(c))).alias(c) for c in "ab")).first()
    assert set(r.a) & set(r.b)


def test_captions_are_the_same_as_by_a_full_scan():
    import random

    from tachado.operators import catalog

    s = detect.Scanner(LEX, catalog.load())
    pattern = next(p for _, caption, p in s.catalog if caption)
    rng, words = random.Random(1), ["Pérez", "Juan", "c/", "contra", "s/", "sobre", "S.A.", "c. ", "daños", "\n", "xsobre", "C/", "Gómez,", " " * 45]
    texts = [" ".join(rng.choice(words[: 14 - (i % 2)]) for _ in range(rng.randint(5, 120))) for i in range(150)]
    assert sum(len(list(pattern.finditer(t))) for t in texts) > 100
    for t in texts:
        assert [m.span() for m in s._captions(pattern, t)] == [m.span() for m in pattern.finditer(t)]
