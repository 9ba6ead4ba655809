import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from tachado import queries
from tachado.functions import arrow
from tachado.functions.lexicon import load
from tachado.operators import detect, detections, resolve
from tachado.operators.review import Review, replay
from tachado.plans.analysis import reviewed
from tachado.sinks import export, pdf, sessions
from tachado.sources import documents as ingest
from tachado.streaming.stream import anonymize_stream

LEX = load()


def test_clean_and_reflow(spark):
    raw = "Texto que\ncontinúa aquí.\n\nOtro-\npárrafo:\nNuevo\n1 | P á g i n a\n23\n- item uno\n- item dos"
    df = spark.createDataFrame([(raw,), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(ingest.reflow(ingest.clean_page_text(F.col("t")))).collect()]
    assert out == ["Texto que continúa aquí.\n\nOtro- párrafo: Nuevo\n\n- item uno\n\n- item dos", "", None]


def test_docx_round_trip(spark, tmp_path):
    data = export.docx_bytes(["Uno & dos", "Tres"])
    assert ingest.docx_text(data) == "Uno & dos\nTres" and zipfile.ZipFile(BytesIO(data)).testzip() is None
    for name, body in {"a.b.docx": data, "x.pdf": b"%PDF", "y.txt": b"t", "z.docx": b"broken", "e.docx": b""}.items():
        (tmp_path / name).write_bytes(body)
    rows = {r.doc_name: (r.text, r.status) for r in ingest.read_uploads(spark, str(tmp_path)).collect()}
    assert rows == {"a.b": ("Uno & dos\nTres", "ok"), "x": (None, "no_reader"), "y": (None, "unsupported"), "z": (None, "damaged")}
    pages = lambda data: ["", "Página con texto\nsuficiente para leer"]
    rows = {r.doc_name: (r.text, r.status) for r in ingest.read_uploads(spark, str(tmp_path), pages).collect()}
    assert rows["x"] == ("Página con texto suficiente para leer", "ok")


def test_csv_guards_formulas(spark):
    rows = [(1, 0, "OTRO", "=1+1", '[a;"b"]', True, [(0, 1, "x")], None)]
    df = spark.createDataFrame(rows, "doc_id long, id int, cat string, original string, placeholder string, enabled boolean, positions array<struct<start:int,end:int,raw:string>>, cluster_id string")
    assert export.csv_documents(df).first().content == '﻿Tipo;Original;Sustitución;Ocurrencias;Activa;Cluster\r\nOTRO;\'=1+1;"[a;""b""]";1;Sí;\r\n'


def test_pdf_is_well_formed(spark):
    import re
    import zlib

    data = pdf.pdf_bytes(["Párrafo (uno) con \\ barra " * 200, "dos", " "], size=11)
    assert data.startswith(b"%PDF") and data.rstrip().endswith(b"%%EOF")
    start_at = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start_at:])]
    assert all(data[p:].startswith(b"%d 0 obj" % (i + 1)) for i, p in enumerate(places))
    pages = [zlib.decompress(m[1]) for m in re.finditer(rb"stream\n(.*?)\nendstream", data, re.S)]
    said = b" ".join(re.findall(rb"\((.*?)\) Tj", b"\n".join(pages), re.S)).decode("cp1252")
    assert said.count("barra") == 200 and said.endswith("dos") and len(pages) > 1
    assert all(pdf.width(" ".join(x), 11) <= 300 for x in pdf.lines("palabra " * 50 + "x" * 500, 11, 300))
    docs = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "editado")], "doc_id long, anonymized_text string, mine string")
    rows = {r.doc_id: bytes(r.content) for r in pdf.pdf_documents(docs, edited="mine").collect()}
    assert len(rows) == 3 and all(len(x) > 200 for x in rows.values()) and rows[1] != rows[3]


def test_files_and_csv_tables(spark, tmp_path):
    rows = [(1, 0, "OTRO", "a;b", "[x]", True, [(0, 1, "x")], None), (None, 0, "OTRO", "c", "[x]", True, [(0, 1, "x")], None)]
    df = spark.createDataFrame(rows, "doc_id long, id int, cat string, original string, placeholder string, enabled boolean, positions array<struct<start:int,end:int,raw:string>>, cluster_id string")
    export.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes().decode()
    assert text.startswith("\ufeffdoc_id;Tipo;") and '1;OTRO;"a;b";[x];1;Sí;' in text and text.count("\r\n") == 3
    files = export.write_files(export.csv_documents(df), f"file://{tmp_path}/one", "csv").collect()
    assert {r.doc_id for r in files} == {1, None}
    assert all((tmp_path / "one" / r.file).stat().st_size == r.size for r in files)


def test_sessions_are_upserted(spark, tmp_path):
    path = f"file://{tmp_path}/sessions"
    assert sessions.load(spark, path).count() == 0
    make = lambda rows: spark.createDataFrame(rows, "session_id string, n int").select("session_id", sessions.state(n=F.col("n")).alias("data"))
    sessions.save(make([("a", 1), ("b", 2), (None, 3)]), path)
    sessions.save(make([("a", None), ("c", 4)]), path)
    assert sorted((r.session_id, r.data) for r in sessions.load(spark, path).collect()) == [("a", '{"n":null}'), ("b", '{"n":2}'), ("c", '{"n":4}')]


def start(text="Ana vio a Ana y a Luis"):
    d = lambda i, s, a: {"id": i, "cat": "PERSONA", "original": s, "placeholder": f"[PERSONA_{i + 1}]", "enabled": True, "positions": [{"start": a, "end": a + len(s), "raw": s}], "mention_ids": [f"m{i}"], "cluster_id": None, "manual_placeholder": False, "user_added": False}
    m = lambda i, s, a: {"mention_id": f"m{i}", "cat": "PERSONA", "surface": s, "start": a, "end": a + len(s)}
    return Review(text, [d(0, "Ana", 0), d(1, "Luis", 18)], [m(0, "Ana", 0), m(1, "Luis", 18)], [])


def test_manual_selection_takes_all_occurrences():
    r = start()
    r.seq = 1
    r.add_manual("PERSONA", "10", "13")
    assert [(p["start"], p["end"]) for p in r.detections[0]["positions"]] == [(0, 3), (10, 13)]
    r.add_bulk("OTRO", "vio", "4-7,4-7", " [V] ")
    assert r.detections[2]["placeholder"] == "[V]" and len(r.detections[2]["positions"]) == 1 and r.detections[2]["user_added"]


def test_groups_confirm_split_absorb_merge_remove():
    r = start()
    r.seq = 1
    r.create_cluster("0,1")
    r.seq = 2
    r.confirm("manual_1")
    assert {d["placeholder"] for d in r.detections} == {"[PERSONA_1]"} and {d["cluster_id"] for d in r.detections} == {"manual_1"}
    r.seq = 3
    r.remove_surface("manual_1", "luis")
    assert [c["surfaces"] for c in r.clusters] == [["Ana"], ["Luis"]] and r.detections[1]["cluster_id"] is None
    r.seq = 4
    r.merge("manual_1,manual_1_split_3")
    assert [c["cluster_id"] for c in r.clusters] == ["merged_4"]
    r.remove("0")
    assert [d["id"] for d in r.detections] == [0] and len(r.mentions) == 1
    r.update("0", cat="EMPRESA", enabled="false")
    assert r.detections[0]["placeholder"] == "[EMPRESA_1]" and not r.detections[0]["enabled"]


def test_replay_reports_what_it_refuses(spark):
    docs = spark.createDataFrame([(1, "correo ana@x.com.ar y luis@y.com"), (2, "b@c.de")], "doc_id long, text string")
    m = detections.mentions(detect.scan(docs, LEX), LEX)
    d = detections.detections(m)
    log = spark.createDataFrame([(1, 1, "remove", {"id": "0"}), (1, 2, "nothing", {}), (1, 3, "ignore", {"ids": "7"})], "doc_id long, seq long, action string, args map<string,string>")
    out = replay(docs, d, m, resolve.clusters(m, resolve.edges(m, LEX)), log).collect()
    assert [(r.doc_id, [x.original for x in r.detections], r.refused) for r in out] == [(1, ["luis@y.com"], [2, 3])]


def test_replay_gives_mentions_and_texts(spark):
    docs = spark.createDataFrame([(1, "Ana Gómez; Ana Gómez Pérez; luis@y.com; Zutano")], "doc_id long, text string")
    m = detections.mentions(detect.scan(docs, LEX), LEX)
    d = detections.detections(m)
    log = spark.createDataFrame([(1, 1, "ignore", {"ids": "2"}), (1, 2, "add_manual", {"cat": "PERSONA", "start": "40", "end": "46"}), (1, 3, "add_manual", {"cat": "DNI", "start": "0", "end": "3"})], "doc_id long, seq long, action string, args map<string,string>")
    r = replay(docs, d, m, resolve.clusters(m, resolve.edges(m, LEX)), log).first()
    assert r.refused == [3] and [x.mention_id for x in r.mentions] == ["m0", "m1", "m2", "m_manual_2"]
    assert r.anonymized_text == "[PERSONA_1]; [PERSONA_2]; luis@y.com; [PERSONA_3]"
    # Pruning drops the shorter name, which then stays in clear; the selection by hand stays.
    assert [x.original for x in r.exported] == ["luis@y.com", "Ana Gómez Pérez", "Zutano"]
    assert r.exported_text == "Ana Gómez; [PERSONA_2]; luis@y.com; [PERSONA_3]"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.cc y c@d.ee, a@b.cc"), (2, None), (3, "x")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = anonymize_stream(stream).writeStream.format("memory").queryName("out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.anonymized_text for r in spark.table("out").collect()}
    assert got == {1: "[EMAIL_1] y [EMAIL_2], [EMAIL_1]", 2: None, 3: "x"}


def test_reviewed_equals_replay_without_moving_rows(spark):
    """Analysis and replay in the document's own row: as from tables, but nothing is joined, shuffled or written."""
    texts = ["Ana Gómez; Ana Gómez Pérez; luis@y.com; Zutano", "Sr. Juan Pérez (DNI 20.123.456) y Juan Pérez; ana@x.com.ar", "nada", None, "b@c.de"]
    acts = [
        [(2, "add_manual", {"cat": "PERSONA", "start": "40", "end": "46"}), (1, "ignore", {"ids": "2"}), (3, "add_manual", {"cat": "DNI", "start": "0", "end": "3"})],
        [(1, "remove", {"id": "0"}), (2, "confirm", {"cluster": "sug_0"}), (3, "nothing", None)], [(1, "remove", {"id": "0"})], [(5, "ignore", {"ids": "0"})], [],
    ]
    kind = "doc_id long, text string, acts array<struct<seq:long,action:string,args:map<string,string>>>"
    docs = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(zip(texts, acts, strict=True))] + [(9, "c@d.es", None)], kind)
    m = detections.mentions(detect.scan(docs, LEX), LEX)
    log = docs.selectExpr("doc_id", "inline(acts)")
    want = replay(docs, detections.prune(detections.detections(m), LEX), m, resolve.groups(m, LEX), log)
    out = reviewed(docs)
    assert out.columns == want.columns
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [0, 1, 2, 3] and got == sorted(want.collect(), key=lambda r: r.doc_id)
    twice = reviewed(docs.where("doc_id = 1").union(docs.where("doc_id = 1"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1] == got[1]
    assert reviewed(docs.limit(0)).count() == 0


def test_review_replay_is_joined_by_nothing(spark):
    plan = queries.review_replay(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_review_replay_goes_through_python_twice(spark):
    """The scan, then linking and replay in one pass; each further pass hands all of a document over once more."""
    plan = queries.review_replay(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_arrow_values_and_arrays():
    import pyarrow as pa

    one = pa.struct([("id", pa.int32()), ("t", pa.string()), ("on", pa.bool_()), ("p", pa.list_(pa.struct([("a", pa.int64()), ("w", pa.float64())])))])
    rows = [
        [{"id": 1, "t": "ñ", "on": True, "p": [{"a": 1, "w": 0.5}, {"a": None, "w": None}]}, {"id": None, "t": None, "on": None, "p": None}], [], None, [None],
        [{"id": 2, "t": "", "on": False, "p": []}],
    ]
    for some in (rows, rows[:2], rows[1:2], [], rows[3:]):
        made = arrow.array(some, pa.list_(one))
        made.validate(full=True)
        assert made.type == pa.list_(one) and made.equals(pa.array(some, pa.list_(one))) and arrow.values(made) == made.to_pylist() == some
    whole = pa.array(rows, pa.list_(one))
    assert all(arrow.values(whole.slice(i, n)) == rows[i : i + n] for i in range(6) for n in range(6))
    unset = pa.ListArray.from_buffers(pa.list_(pa.string()), 0, [None, pa.py_buffer(b"\xff" * 4)], children=[pa.array(["x"])])
    assert arrow.values(unset) == []
    assert arrow.values(pa.array([{"x": 1}, None, {"x": None}])) == [{"x": 1}, None, {"x": None}] and arrow.values(pa.array([1.5, None])) == [1.5, None]
