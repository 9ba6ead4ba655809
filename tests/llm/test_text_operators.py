import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tachado.llm import fingerprints, packing, quality, queries, simhash, tokencount
from tachado.llm.bpe import TokenBytes, TokenCounter, public_path

DIR = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "<|endoftext|>", "a<|endoftext|>b", "Don't WE'LL ½ 123", "ΑΣ ΣΑΣ İ ﬀ", "\x1ca\x1d b", "日本 中文 😀👍🏽", "x" * 3000, "a\x00b\x85c\u3000d", "'s 's'S", "same", "same", "e\u0301 é"]
SCHEMA = "doc_id long, text string, n_tokens string, k string, fp int"  # extra columns with clashing names


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x", "y", 7) for i, t in enumerate(texts)], SCHEMA)


def sample_texts(spark):
    return [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, library):
    texts = ODD + sample_texts(spark)
    rows = tokencount.token_counts(docs_of(spark, texts), public_path("word_bpe_49k.json")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)
    none = spark.createDataFrame([], SCHEMA)
    assert tokencount.token_counts(none, public_path("word_bpe_49k.json")).count() == 0


def test_kept_words_start_anew(library):
    path = public_path("word_bpe_49k.json")
    text = " ".join(f"wörd{i % 50}, tail{i}." for i in range(400))
    want = library.encode(text, add_special_tokens=False).ids
    assert TokenCounter(path, most=7).count(text) == len(want)
    assert np.frombuffer(TokenBytes(path, most=7).ids(text), "<u4").tolist() == want


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


def test_simhash_equals_brute_force(spark):
    texts = ODD + sample_texts(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {k: r.fp & 0xFFFFFFFFFFFFFFFF for k, r in got.items()} == want
    assert {k: r.component_id for k, r in got.items()} == brute_components(want)


def test_simhash_links_keep_every_component(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(120)} | {0, 7})
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    from tachado.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: got.get(i, i) for i in want} == want
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_simhash_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two three"), (5, "one two three"), (None, "solo"), (5, "one two three")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert rows == [(0, 5), (0, None), (5, 5), (5, 5)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_rows_without_a_key_link_others(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    fps = {"a": 0, "b": 7, "c": 63}
    import tachado.llm.simhash as module

    real = module._fingerprints
    try:
        module._fingerprints = lambda texts, shingle: [fps[t] for t in texts]
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        module._fingerprints = real
    assert got == {1: 1, None: 1, 2: 1}


def test_simhash_large_groups_lose_no_link(spark):
    from tachado.llm.components import components

    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(150)})
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r.node: r.component for r in components(simhash.links(nodes, most=4)).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: got.get(i, i) for i in want} == want


def test_simhash_columns_with_any_names(spark):
    df = spark.createDataFrame([(1, "x y z", "p", 5, 6), (2, None, None, None, 7)], "doc_id long, text string, _k string, _t int, k int")
    rows = {r.doc_id: r for r in simhash.near_duplicates(df, carry=["_k", "_t", "k"]).collect()}
    assert (rows[1]._k, rows[1]._t, rows[1].k) == ("p", 5, 6) and rows[2].fp == 0


def bag(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)


def jaccard(a, b):
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    texts = sample_texts(spark) + ODD
    rows = {r.doc_id: r for r in fingerprints.neighbours(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        t, u = t or "", texts[i - 1 if i else len(texts) - 1] or ""
        n = len(t)
        edited = t[: n - n // 2] + u[: n // 2]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        errors += [jaccard(bag(t), bag(edited)) - r.near_edited, jaccard(bag(t), bag(u)) - r.near_next]
        assert all(len(x) == 8 * fingerprints.SAMPLES for x in (r.fingerprint, r.edited_fingerprint))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.1
    same = [i for i, t in enumerate(texts) if t == "same"]
    assert rows[same[0]].fingerprint == rows[same[1]].fingerprint and rows[same[1]].near_next == 1.0


def test_fingerprints_ranges_and_single_rows(spark):
    df = spark.createDataFrame([(i * i, f"w{i} common words") for i in range(60)] + [(None, "last one")], "doc_id long, text string")
    rows = fingerprints.in_ranges(df, "doc_id", "text", size=7)
    assert rows.where("extra = 0").count() == 61
    assert rows.where("extra = 1").count() == rows.select("bucket").distinct().count()
    one = fingerprints.neighbours(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert fingerprints.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("keys", [
    [*range(1, 40), 2**62], [-(2**63), 2**63 - 1, 0, 5, -7], [None] * 60 + [3, 9], [4] * 50 + [1, 9, None, 2**63 - 1, 2**63 - 1], [None] * 5,
])
def test_fingerprints_ranges_of_odd_keys(spark, keys):
    """Ranges stay small, and every document's next one is the one of the whole order."""
    df = spark.createDataFrame([(k, f"text {i} of some words") for i, k in enumerate(keys)], "id long, t string").repartition(3)
    rows = fingerprints.in_ranges(df, "id", "t", size=5).collect()
    own = Counter(r.bucket for r in rows if r.extra == 0)
    assert sum(own.values()) == len(keys) and max(own.values()) <= 15
    line = [r.t for b in sorted(own) for r in sorted((r for r in rows if r.bucket == b and not r.extra), key=lambda r: (r.k is None, -(r.k or 0), r.h))]
    flat = [r for r in rows if not r.extra]
    want = [r.t for r in sorted(flat, key=lambda r: (r.k is None, -(r.k or 0), r.h))]
    assert line == want
    heads = {r.bucket: r.t for r in rows if r.extra}
    order = sorted(own)
    firsts = {b: next(t for t in line if t in {r.t for r in flat if r.bucket == b}) for b in order}
    assert heads == {b: firsts[order[(i + 1) % len(order)]] for i, b in enumerate(order)}


def test_quality_learns_from_what_is_not_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95


def test_quality_without_labels_and_odd_rows(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([(None, 1), (1, None), (2, 5)], "doc_id long, quality int")
    rows = quality.scores(docs, quality.train(docs, none), ["doc_id"]).collect()
    assert len(rows) == len(ODD) and {r._score for r in rows} == {0.5}
    kept = quality.scores(docs, quality.train(docs, none), docs.columns)
    assert kept.where("text is null").count() == 1


def test_quality_sample_counts_repeated_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())))
    docs = spark.createDataFrame([(i % 40, f"text number {i % 90}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for parts in (1, 7):
        quality.train(docs.repartition(parts), labels, sample=30)
    assert len(seen[0][0]) == 30 and seen[0] == seen[1]


def test_trees_equal_plain_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, trees=20)

    def one(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - (2**model.depth - 1)]
        return total

    assert np.allclose(model.margin(x), [one(r) for r in x]) and ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_packing_round_trip(spark, library):
    texts = ODD + sample_texts(spark) + ["word " * 9000]
    rows = packing.pack(docs_of(spark, texts).repartition(3), public_path("word_bpe_49k.json")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0 and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def whole(sizes, capacity=4096):
    """windows_of(), checked: every size whole, no window above capacity; the number of windows."""
    parts, pieces = packing.windows_of(sizes, capacity), {}
    assert max(sum(n for _, _, n in p) for p in parts) <= capacity
    for i, start, n in (x for p in parts for x in p):
        pieces.setdefault(i, []).append((start, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at and n > 0
            at += n
        assert at == size
    return len(parts)


def test_differencing_balances_and_cuts_what_is_above():
    import time

    rng = np.random.default_rng(2)
    began = time.time()
    for sizes in (
        rng.integers(1, 4096, 600), rng.integers(1, 1200, 900), rng.integers(2100, 2300, 1024), rng.integers(2047, 2050, 2047), np.full(1024, 4095), np.full(1000, 2049), np.ones(700, int), [4000, 4000], [7],
    ):
        sizes = [int(x) for x in sizes]
        least = -(-sum(sizes) // 4096)
        assert whole(sizes) <= least + max(1, least // 100)
    assert time.time() - began < 30
    assert packing.windows_of([4000, 4000], 4096) == [[(0, 0, 4000)], [(1, 0, 4000)]]
    sizes = [int(x) for x in rng.integers(1, 1200, 900)]
    loads = [sum(sizes[i] for i in p) for p in packing.difference(sizes, 140)]
    assert max(loads) - min(loads) <= 60


def test_uniform_long_documents_leave_little_padding(spark, library):
    texts = ["word " * (1100 + i % 7) for i in range(400)]
    rows = packing.pack(docs_of(spark, texts).repartition(2), public_path("word_bpe_49k.json")).collect()
    load = Counter()
    for r in rows:
        load[r.sequence_id] += r.length
    assert sum(load.values()) >= 0.98 * 4096 * (len(load) - 2)
