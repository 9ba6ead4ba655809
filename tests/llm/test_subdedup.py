import random
from collections import defaultdict

import pytest

from tachado.llm import subdedup

RNG = random.Random(5)


def new_words(n, rng=RNG):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


def inside(words, rng=RNG):
    """words within a line of their own, far longer than they are."""
    return " ".join(new_words(300, rng) + words + new_words(300, rng))


def kept(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return {r.doc_id: r.text for r in subdedup.dedup(df).collect()}


def brute_force(docs, least=25):
    """Words that stay, by document: every run of `least` words that stands before (by key, then place) goes."""
    first, out = {}, {}
    words = {k: t.split() for k, t in docs.items()}
    for k in sorted(docs):
        for i in range(len(words[k]) - least + 1):
            first.setdefault(tuple(words[k][i : i + least]), (k, i))
    for k, w in words.items():
        away, here, guarded = set(), set(), set()
        for i in range(len(w) - least + 1):
            q, at = first[tuple(w[i : i + least])]
            if (q, at) != (k, i):
                (here if q == k else away).update(range(i, i + least))
                if q == k:
                    guarded.update(range(at, at + least))
        gone = away | (here - guarded)
        runs, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and j in gone:
                j += 1
            if j - i >= least:
                runs += range(i, j)
            i = max(j, i + 1)
        runs = set(runs)
        out[k] = [x for i, x in enumerate(w) if i not in runs]
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(11)
    pool = [new_words(rng.choice([25, 26, 30, 40, 55, 130]), rng) for _ in range(12)]
    pool += [(new_words(p, rng) * 60)[:60] for p in (1, 2, 3, 6, 7)]
    docs = {}
    for k in range(1, 61):
        words = new_words(rng.randint(150, 300), rng)
        for _ in range(rng.randint(0, 4)):
            passage = rng.choice(pool)
            a = rng.randint(0, max(0, len(passage) - 20))
            cut = passage[a:] if rng.random() < 0.3 else passage
            words += cut + new_words(rng.randint(80, 200), rng)
        docs[k] = " ".join(words)
    docs[61] = docs[60]
    docs[62] = " ".join(new_words(4, rng) * 30)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in subdedup.dedup(df.repartition(7)).collect()}
    want = brute_force(docs)
    assert sum(len(t.split()) for t in docs.values()) - sum(map(len, want.values())) > 2000
    assert got == want


@pytest.mark.parametrize("n", [25, 30, 40, 50])
def test_every_repeated_passage_of_so_many_words_goes(spark, n):
    rng = random.Random(n)
    passages = [new_words(n, rng) for _ in range(100)]
    docs = {2 * i + j: inside(p, rng) for i, p in enumerate(passages) for j in (0, 1)}
    got = {r.doc_id: r.text for r in subdedup.dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for i in range(100):
        assert got[2 * i] == docs[2 * i]
        words = docs[2 * i + 1].split()
        assert got[2 * i + 1].split() == words[:300] + words[-300:]


def test_words_substituted_between_equal_passages_stay(spark):
    shared = new_words(70)
    other = shared[:30] + new_words(3) + shared[33:]
    first, second = inside(shared), inside(other)
    got = kept(spark, first, second)
    assert got[1] == first
    assert got[2].split() == second.split()[:300] + other[30:33] + second.split()[-300:]


def test_long_equal_passages_go_whole(spark):
    shared = new_words(4000)
    first, second = inside(shared), inside(shared)
    got = kept(spark, first, second)
    assert got[1] == first and got[2].split() == second.split()[:300] + second.split()[-300:]


def test_runs_of_short_near_equal_lines_go(spark):
    lines = [new_words(20) for _ in range(4)]
    near = [line[:-1] + new_words(1) for line in lines]
    head, alone = new_words(300), [new_words(300), near[0], new_words(300)]
    join = lambda rows: "\n".join(map(" ".join, rows))
    got = kept(spark, join(lines), join([head, *near]), join(alone))
    assert got[1] == join(lines) and got[2].split() == head and got[3] == join(alone)


def test_cycles_keep_their_first_words_once(spark):
    cycle = new_words(3) * 40
    first, second = inside(cycle), inside(cycle)
    got = kept(spark, first, second)
    own = got[1].split()
    assert own == first.split()[:300] + cycle[:27] + first.split()[-300:]
    assert got[2].split() == second.split()[:300] + second.split()[-300:]


def near_groups(lines, similarity=0.8):
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = defaultdict(set)
    for i in range(len(lines)):
        out[root(i)].add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("chunk", [1024, 3])
def test_line_classes_equal_brute_force_in_chunks_too(spark, monkeypatch, chunk):
    from tachado.llm.common import Tables
    from tachado.llm.components import components

    monkeypatch.setattr(subdedup, "CHUNK", chunk)
    rng = random.Random(4)
    base = [new_words(60, rng) for _ in range(6)]
    lines = []
    for b in base:
        for _ in range(14):
            words = list(b)
            for _ in range(rng.randint(0, 5)):
                words[rng.randint(0, 59)] = "changed" + str(rng.randint(0, 9))
            lines.append(words)
    docs = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(lines)], "rid long, k long, t string")
    put = Tables(spark)
    cut, passages = subdedup._cut(docs, 25, put)
    members, places = subdedup._colliding(cut, put)
    met, kinds = subdedup._collisions(passages, 25, put)
    sets = subdedup._details(docs, places, met, kinds, 25, put).where("s is not null").select("u", "s")
    reached = {r.node: r.component for r in components(subdedup._near_links(members, sets, 0.8, put)).collect()}
    got = defaultdict(set)
    for r in cut.collect():
        got[reached.get(r.u, r.u)].add(r.rid)
    assert sorted(map(sorted, got.values())) == near_groups(lines)


def test_odd_rows_and_clashing_names(spark):
    p = new_words(60)
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, inside(p)), (2, None), (3, ""), (None, inside(p)), (4, " \n\t  "), (5, long), (6, "x " * 30000), (7, inside(p)), (7, inside(p))]
    rows.append(rows[-1])
    names = "_rid string, _hit string, _slot string, _word string, _bits string, _found string, k string, T int, word string, bits string"
    df = spark.createDataFrame([(*r, *["e"] * 7, 1, "e", "e") for r in rows], f"doc_id long, text string, {names}")
    out = subdedup.dedup(df)
    assert out.columns == [*df.columns, "_stretches", "_words", "_firsts"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert all(r._rid == "e" and r._hit == "e" and r._found == "e" for r in out.collect())
    for i in (0, 1, 2, 3, 4, 5):
        assert got.count(rows[i]) == 1
    words = lambda i: rows[i][1].split()
    cut = [t.split() for k, t in got if k == 7]
    assert sorted(cut) == sorted([words(7)[:300] + words(7)[-300:]] + [words(8)[:300] + words(8)[-300:]] * 2)
    groups = {(r.doc_id, r.class_id) for r in subdedup.classes(out).collect()}
    assert {(1, 1), (2, 2), (7, 1), (None, None)} <= groups
