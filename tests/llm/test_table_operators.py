import base64
import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tachado.llm import ann, mixing, queries, subdedup, urlfilter, warc

DIR = "/root/testdata/sf0.001"


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def test_passages_inside_lines_are_found_once(spark):
    p = passage(1, 55)
    docs = [(i, f"{passage(100 + i, 40)} {p} {passage(200 + i, 40)}\n{passage(300 + i, 30)}") for i in range(6)]
    docs += [(10, passage(900, 200)), (11, None), (12, ""), (None, f"x {p}"), (13, "short line")]
    out = subdedup.dedup(spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, rid string, k int"))
    assert out.columns[:4] == ["doc_id", "text", "rid", "k"]
    rows = {r.doc_id: r for r in out.collect()}
    want = dict(docs)
    assert p in rows[0].text and rows[0].text == want[0]
    for i in range(1, 6):
        left = f"{passage(100 + i, 40)} {passage(200 + i, 40)}\n{passage(300 + i, 30)}"
        assert rows[i].text == left and rows[i]._words == 55 and rows[i]._firsts == [0]
    for k in (10, 11, 12, 13, None):
        assert rows[k].text == want[k]
    groups = {r.doc_id: r.class_id for r in subdedup.classes(out).collect()}
    assert [groups[i] for i in (0, 1, 5, 10)] == [0, 0, 0, 10]


def test_substring_dedup_of_nothing_and_repeats(spark):
    assert subdedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = passage(5, 80)
    twice = spark.createDataFrame([(1, text), (1, text), (2, text), (3, f"{text}\n{passage(6, 30)}\n{text}")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text) for r in subdedup.dedup(twice).collect())
    assert rows == [(1, text), (1, text), (2, ""), (3, f"{passage(6, 30)}\n")]
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60000)))], "doc_id long, text string")
    assert subdedup.dedup(long).first()._words == 0


def test_warc_round_trip(spark):
    pages = [(3, "http://a/", "x" * 500), (1, "http://b c\r\n/", "x" * 500), (2, None, None), (7, "u", ""), (5, "u", "é\r\n\r\nz"), (5, "u", "é\r\n\r\nz"), (None, "n", "x" * 500), (9, "m", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    rows = Counter(tuple(r) for r in warc.round_trip(df.repartition(3)).collect())
    want = Counter()
    for k, _, h in pages:
        payload = (h or "").encode()
        first = min(q for q, _, g in pages if (g or "") == (h or "") and q is not None)
        revisit = k is None or k != first
        want[(k, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    # a record without a key that shares its payload is told by what it repeats, not by a key of its own
    assert {r for r in rows if r[0] is not None} == {r for r in want if r[0] is not None} and sum(rows.values()) == len(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_members_are_gzip_of_their_own():
    block = warc.STATUS + b"Content-Length: 3\r\n\r\nabc"
    data = b"".join(warc._gzip(warc.record("response", str(i), f"http://h/{i}", "D", block), 6) for i in range(3))

    class File:
        def __init__(self, raw):
            self.raw = raw

        def read(self, n):
            out, self.raw = self.raw[:7], self.raw[7:]
            return out

    got = list(warc.records(warc.inflate(File(data))))
    assert [h["warc-record-id"] for h, _ in got] == [f"<urn:record:{i}>" for i in range(3)] and {b for _, b in got} == {block}


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            s = sorted((-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in good if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_neighbours_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 360)]
    rows += [(400, None), (450, []), (500, [0.0] * 8), (550, [float("nan")] + [1.0] * 7), (600, [None] + [1.0] * 7), (650, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<double>, list string")
    got = defaultdict(dict)
    for r in ann.nearest(df).collect():
        got[r.query_id][r.rank] = r.vec_id
    want = brute_nearest([r for r in rows if r[0] is not None], 50, 5)
    assert set(got) == set(want)
    assert [got[350][i] for i in range(1, 6)] == [300, 301, 302, 303, 304] and [got[300][i] for i in range(1, 6)] == [301, 302, 303, 304, 305]
    hits = sum(len(set(got[q].values()) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def brute_scores(rows, every, k):
    out = []
    for i, q in rows:
        if i % every == 0:
            q = np.array(q, float)
            s = [(-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in ((j, np.array(v, float)) for j, v in rows if j != i and len(v) == len(q))]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(sorted(s)[:k])]
    return out


def test_neighbours_ties_go_to_the_smaller_keys(spark):
    base = [0.5, -1.25, 3.0, 0.75, 2.0, -0.5, 1.0, 4.0]
    rows = [(100 + i, [x * 2.0 ** ((7 * i) % 43 - 21) for x in base]) for i in range(43)]
    rows += [(200 + i, [1.0, float(i), 2.0]) for i in range(12)] + [(300, [2.0, 4.0, 4.0]), (400, [1.0])]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "vec_id long, embedding array<double>, d int, far string").repartition(5)
    got = sorted(tuple(r) for r in ann.nearest(df).collect())
    want = sorted(brute_scores(rows, 50, 5))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-15)
    assert [r[2] for r in got if r[0] == 100] == [101, 102, 103, 104, 105]


def test_neighbours_in_levels(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.3 * rng.normal(size=8)]) for i in range(3000)] + [(3000 + i, [2.0**i] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "CENTROIDS", 8)
    monkeypatch.setattr(ann, "CELLS", 6)
    got = defaultdict(set)
    for r in ann.nearest(df, list_size=48, chunk=96).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_nearest(rows, 50, 5)
    assert set(got) == set(want) and got[3000] == {3001, 3002, 3003, 3004, 3005}
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("n", [1900, 2200])
def test_neighbours_recall_is_kept_beyond_full_lists(spark, monkeypatch, n):
    """More vectors than CENTROIDS lists of list_size hold (2048 here) are searched as thoroughly as fewer."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(11).normal(size=(n, 32)))]
    monkeypatch.setattr(ann, "CENTROIDS", 128)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_size=16, prune=9.0).collect()}
    want = {(q, v) for q, _, v, _ in brute_scores(rows, 50, 5)}
    assert len(got) == len(want) == 5 * n // 50
    assert len(got & want) >= 0.9 * len(want)


def test_neighbours_plain_values_only(spark):
    """What is broadcast needs no module of ours on the executors."""
    import pickletools

    blob = __import__("pickle").dumps(ann.graph_of(np.eye(4, dtype=np.float32)))
    assert not any("tachado" in str(arg) for _, arg, _ in pickletools.genops(blob))


def test_neighbours_recall(spark):
    d = "/root/testdata/sf0.1"
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ids = np.array(sorted(x))
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    found = defaultdict(set)
    for r in queries.op8_nearest_neighbours(spark, d).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s = u @ u[n]
        s[n] = -2
        best = set(ids[np.argsort(-s)[:5]].tolist())
        hits, total = hits + len(best & found[int(ids[n])]), total + 5
    assert hits / total >= 0.9


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(8)
    c = rng.normal(size=(300, 16)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    ids, _ = ann.search(ann.graph_of(c), x, 16)
    best = np.argsort(-(x @ c.T), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(ids, best, strict=True)]) > 0.95


def brute_fill(nodes, budget):
    """Water filling by repeated rounds: nodes {name: (capacity, weight)}."""
    out, open_ = {}, dict(nodes)
    while open_:
        level = budget / sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c / w <= level}
        if not full:
            return out | {k: level * w for k, (_, w) in open_.items()}
        out |= full
        budget -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def brute_mix(docs, weights, epochs, share, seed):
    leaves = Counter()
    for d in docs:
        leaves[d[1:4]] += d[4]
    give = {(): min(np.floor(sum(leaves.values()) * share), sum(leaves.values()) * epochs)}
    for depth, level in enumerate(("domain", "lang", "source")):
        caps = Counter()
        for leaf, n in leaves.items():
            caps[leaf[: depth + 1]] += n * epochs
        new = {}
        for parent, b in give.items():
            kids = {k: (c, weights.get(level, {}).get(k[-1], 1.0)) for k, c in caps.items() if k[:-1] == parent}
            new |= brute_fill(kids, b)
        give = new
    out = Counter()
    for leaf, n in leaves.items():
        b = int(np.floor(give[leaf] + 1e-6))
        whole, rest = (b // n, b % n) if n else (0, 0)
        own = [d for d in docs if d[1:4] == leaf]
        for e in range(whole):
            out.update((d[0], e) for d in own)
        run = 0
        if rest:
            for d in sorted(own, key=lambda d: (hashlib.md5(f"{seed}|{whole}|{d[0]}".encode()).hexdigest()[:15], d[0])):
                run += d[4]
                if run > rest:
                    break
                out[(d[0], whole)] += 1
    return out


def test_mixing_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    docs = []
    for i in range(700):
        n = int(rng.integers(0, 40))
        docs.append((i, f"d{int(rng.integers(0, 3))}", ["en", "de", ""][int(rng.integers(0, 3))], f"s{int(min(rng.geometric(0.5), 5))}", n))
    weights = {"domain": {"d0": 5.0, "d1": 1.0}, "lang": {"en": 3.0}, "source": {"s5": 9.0}}
    df = spark.createDataFrame([(i, d, lang or None, s, " ".join(["w"] * n) if n else None, 3) for i, d, lang, s, n in docs], "doc_id long, domain string, lang string, source string, text string, tokens int")
    for epochs, share in ((3, 1.0), (1, 0.8), (2, 5.0), (4, 0.01)):
        got = Counter((r.doc_id, r.epoch) for r in mixing.mix(df, ["domain", "lang", "source"], weights, epochs=epochs, share=share).collect())
        assert got == brute_mix(docs, weights, epochs, share, 7), (epochs, share)
    assert mixing.mix(df.limit(0), ["domain", "lang", "source"], weights).count() == 0


def test_url_filter_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    want = sorted(con.execute(queries.OP10_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op10_url_filters(spark, DIR).collect()) == want


def test_url_filter_equals_brute_force(spark):
    rules = [("allow", "com", "/"), ("block", "b.com", "/x"), ("allow", "a.b.com", "/x/"), ("block", "a.b.com", "/x/"), ("block", "net", ""), (None, "org", "/"), ("allow", "b.com", "/xy/z")]
    urls = [None, "", "nothing", "http://A.B.com/x/1", "https://b.com", "s://b.com/xy/zz?q", "http://xb.com/x", "t://b.com?x/y", "u://net#f", "u://sub..net/é/é", "http://a.com://b", "http://A.B.com/x/1", "x" * 70_000]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, spark.createDataFrame(rules, urlfilter.RULES)).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if u and "://" in u else ""
        cut = min([j for c in "/?#" if (j := rest.find(c)) >= 0] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if v and ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[3], best[4] if best else "allow")
