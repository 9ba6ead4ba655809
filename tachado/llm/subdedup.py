"""Substring dedup: paragraph MinHash banding, exact verification, components, removal of all but the first.

Paragraphs are cut two ways, and both go through bands.

* Lines of at least SHINGLE words. Equal ones are one node; distinct ones that collide in a MinHash band (BANDS
  bands of ROWS: 99.8 % recall at similarity 0.8) are verified by the exact Jaccard similarity of their five-word
  shingles and joined into components. Of a component the line of the smallest document (there the first) stays.
* Passages: every run of `least` words, wherever lines break. A passage's one band is the least hash of its
  RUN-word shingles. Neighbouring passages mostly share that shingle, so a stretch of passages with one band is one
  row (its first passage and how many follow), about two rows for every nineteen words, one for a whole cycle.
  Equal passages have equal bands, so none is lost. Stretches that collide are
  verified: equal stretches by a hash of all their words; of bands with several distinct stretches, one of each is
  cut into its passages, which are compared by a hash of their words (similarity 1). What colliding stretches
  have in common is thereby found to the word, without a limit to its length. Of equal passages the one in the
  smallest document (key, then hash of the text, then place) stays.

What goes is the union of the copies' words; inside one document a copy loses only words that no first occurrence
there covers. Adjoining removed paragraphs merge; a merged stretch goes if it has at least `least` words.

Only narrow rows are shuffled: texts move only for documents whose paragraphs are verified or rewritten, which a
fixed-size bit filter picks out. Equal paragraphs are collapsed before they are compared. A band's group of more
than CHUNK lines is not one task's: each line is first compared with the group's head; those that are not like it
meet all others chunk by chunk, so no link is lost and no task holds more than two chunks.

Defined cases: null and empty texts have no paragraphs and stay; rows with a null key take no part and stay;
rows that repeat key and text are one document (each keeps the same text); different texts under one key are
documents of their own; a document whose words all go keeps an empty text; ties go to the smaller key, then to
the smaller hash of the text, then to the earlier place; columns of the caller may have any names; an empty table
gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh, id_filter, materialise, maybe_in, text_of
from .components import components
from .simhash import _forest

SHINGLE, BANDS, ROWS = 5, 9, 3
#: Words of the shingles whose least hash is a passage's band; a passage has at least twice as many.
RUN = 8
#: Most lines of a band's group that one task compares with each other.
CHUNK = 1024
ADDED = ("_stretches", "_words", "_firsts")
WORD = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[str]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


class Words:
    """Hashes of a run of words, and of any stretch of them, whatever stands around it."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.h, n = _hashes(words), len(words)
        power = np.full(n + 1, BASE, np.uint64)
        back = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        power[:1] = back[:1] = 1
        self.back = back.cumprod(dtype=np.uint64)
        self.sums = np.r_[np.zeros(1, np.uint64), (_mix(self.h) * power.cumprod(dtype=np.uint64)[:n]).cumsum(dtype=np.uint64)]

    def of(self, start, size):
        """Hashes of the stretches that begin at `start` (array) and have `size` words (array or number)."""
        import numpy as np

        return _mix((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size).astype(np.uint64))

    def all_of(self, n: int):
        """A hash of each run of n words, in order."""
        import numpy as np

        return self.of(np.arange(max(0, len(self.h) - n + 1)), n)


def _least(x, n: int):
    """The least of each n neighbours."""
    import numpy as np

    size = 1
    while size < n:
        step = min(size, n - size)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        size += step
    return x


def stretches(words: Words, sizes, least: int):
    """Of documents one after the other, of so many words: (starts, counts, bands) of stretches of passages with one band.

    A stretch of n passages begins at `start` and covers n + least - 1 words.
    """
    import numpy as np

    run = _run(least)
    none = np.zeros(0, np.int64)
    if len(words.h) < least:
        return none, none, none.view(np.uint64)
    grams = words.all_of(run)
    band = _least(grams, least - run + 1)
    at = np.flatnonzero(np.arange(len(band)) + least <= np.repeat(sizes.cumsum(), sizes)[: len(band)])
    if not len(at):
        return none, none, none.view(np.uint64)
    new = np.flatnonzero(np.r_[True, (band[at[1:]] != band[at[:-1]]) | (np.diff(at) > 1)])
    return at[new], np.diff(np.r_[new, len(at)]), band[at[new]]


def _flat(starts, counts):
    """The numbers from each start on, as many as counted, one after the other."""
    import numpy as np

    return np.arange(counts.sum()) + np.repeat(starts - (counts.cumsum() - counts), counts)


def banded(words: Words, starts, sizes):
    """Hashes and bands of lines, given their places."""
    import numpy as np

    bands = np.zeros((BANDS, len(sizes)), np.uint64)
    if not len(sizes):
        return np.zeros(0, np.uint64), bands
    each = sizes - SHINGLE + 1
    cuts, inside = each.cumsum() - each, words.all_of(SHINGLE)[_flat(starts, each)]
    for b in range(BANDS):
        key = np.full(len(sizes), b + 1, np.uint64)
        for r in range(ROWS):
            seed = np.uint64(((b * ROWS + r + 1) * BASE) & 0xFFFFFFFFFFFFFFFF)
            key = _mix(key * np.uint64(31) + np.minimum.reduceat(_mix(inside ^ seed), cuts))
        bands[b] = key
    return words.of(starts, sizes), bands


def _cut(docs: DataFrame, least: int, put: Tables) -> tuple[DataFrame, DataFrame]:
    """Views of a written table of paragraphs: lines (rid, k, at, n, u, b0..) and stretches (rid, k, at, n, u, g, again)."""
    names = ["rid", "k", "at", "n", "u", "g", "again", *(f"b{i}" for i in range(BANDS))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(held):
            """Paragraphs of some documents, given as (rid, k, lines of words)."""
            words = Words([w for _, _, lines in held for line in lines for w in line])
            owner = np.repeat(np.arange(len(held)), [len(lines) for _, _, lines in held])
            size = np.fromiter((len(line) for _, _, lines in held for line in lines), np.int64, len(owner))
            whole = np.bincount(owner, size, len(held)).astype(np.int64)
            base = whole.cumsum() - whole
            big = size >= SHINGLE
            first, size, owner = (size.cumsum() - size)[big], size[big], owner[big]
            u, bands = banded(words, first, size)
            start, count, band = stretches(words, whole, least)
            whose = np.searchsorted(whole.cumsum(), start, side="right")
            of = np.r_[owner, whose]
            rid, k = (np.array(x, np.int64)[of] for x in list(zip(*held, strict=True))[:2])
            at = np.r_[first, start] - base[of]
            spans = words.of(start, count + (least - 1))
            columns = [rid, k, at.astype(np.int32), np.r_[size, count].astype(np.int32), np.r_[u, band].view(np.int64)]
            none = pa.nulls(len(start), pa.int64())
            g = pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(spans.view(np.int64))])
            again = np.ones(len(of), bool)  # the same stretch stands before in the document
            again[len(u) + np.unique(_mix(spans + whose.astype(np.uint64) * np.uint64(BASE)), return_index=True)[1]] = False
            keys = [pa.concat_arrays([pa.array(x.view(np.int64)), none]) for x in bands]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), g, pa.array(again), *keys], names=names)

        held, size = [], 0
        for b in batches:
            for rid, k, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((rid, k, [line.split() for line in text.split("\n")]))
                size += len(text)
                if size >= 1 << 20:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    kinds = ["bigint", "bigint", "int", "int", "bigint", "bigint", "boolean"] + ["bigint"] * BANDS
    units = put(docs.select("rid", "k", "t").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True))), "paragraphs")
    return units.where("g is null").drop("g", "again"), units.where("g is not null").select("rid", "k", "at", "n", "u", "g", "again")


def _of_hit(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """df's rows whose column is in wanted (column): a bit filter first, so that few others move."""
    near = maybe_in(df, column, id_filter(wanted, column)).where("_hit").select(*df.columns)
    return near.join(wanted, column, "left_semi")


def _run(least: int) -> int:
    return max(1, min(RUN, least // 2))


def _collisions(passages: DataFrame, least: int, put: Tables) -> tuple[DataFrame, DataFrame]:
    """Written tables: stretches whose band has others (rid, k, at, n, u, g, again), and one of each kind of stretch.

    The latter (u, g, k, rid, at, n, c, mixed): first place, how many are equal, and whether it is to be cut up, since the
    band has other kinds or the stretch repeats itself (one place of a shingle is in `least - _run + 1` passages).
    """
    itself = f"n > {least - _run(least) + 1}"
    shared = passages.groupBy("u").agg(F.count("*").alias("c"), F.max(F.expr(itself)).alias("x")).where("c > 1 or x").select("u")
    met = put(_of_hit(passages, shared, "u"), "passage-collisions")
    kinds = met.groupBy("u", "g").agg(F.min(F.struct("k", "rid", "at", "n")).alias("p"), F.count("*").alias("c"))
    kinds = put(kinds.select("u", "g", "p.*", "c"), "passage-kinds")
    mixed = kinds.groupBy("u").agg(F.count("*").alias("m"), F.max(F.expr(itself)).alias("x")).where("m > 1 or x").select("u", F.lit(True).alias("mixed"))
    return met, kinds.join(mixed, "u", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))


def _details(docs: DataFrame, places: DataFrame, met: DataFrame, kinds: DataFrame, least: int, put: Tables) -> DataFrame:
    """A written table of shingle sets (u, s) of the lines at `places`, and of passages (u, w, rid, k, at, more) of mixed bands.

    Of those one stretch of each kind is cut up, and what a document repeats itself. Texts move once, and only of
    documents that hold one of them.
    """
    names, kind = ["u", "s", "w", "rid", "k", "at", "more"], "u bigint, s array<bigint>, w bigint, rid bigint, k bigint, at int, more array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def sets(rows):
            flat = pa.array(np.concatenate([x for _, x in rows]))
            ends = np.r_[0, np.cumsum([len(x) for _, x in rows])].astype(np.int32)
            none = pa.nulls(len(rows), pa.int64())
            columns = [pa.array([u for u, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), none, none, none, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def parts(rows):
            u, w, rid, k, at, many, more = (np.concatenate(x) for x in zip(*rows, strict=True))
            ends = pa.array(np.r_[0, many.cumsum()].astype(np.int32))
            columns = [pa.array(u), pa.nulls(len(u), pa.list_(pa.int64())), pa.array(w.view(np.int64)), pa.array(rid), pa.array(k), pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(more.astype(np.int32)))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            asked = b.column(3)
            ends = np.r_[0, asked.value_lengths().to_numpy(zero_copy_only=False).cumsum()].tolist()
            ask_u, ask_at, ask_n, ask_line = (x.to_numpy(zero_copy_only=False) for x in asked.flatten().flatten())
            shingles, passages, held = [], [], 0
            for i, (rid, k, text) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
                words = Words(text.split())
                mine = slice(ends[i], ends[i + 1])
                line, u, at, n = ask_line[mine], ask_u[mine], ask_at[mine].astype(np.int64), ask_n[mine].astype(np.int64)
                if line.any():
                    grams = words.all_of(SHINGLE).view(np.int64)
                    shingles += [(x, np.unique(grams[p : p + m - SHINGLE + 1])) for x, p, m in zip(u[line].tolist(), at[line].tolist(), n[line].tolist(), strict=True)]
                if not line.all():
                    u, n, at = u[~line], n[~line], at[~line]
                    u, at = np.repeat(u, n), _flat(at, n)
                    w = words.of(at, least)
                    order = np.lexsort((at, w))  # passages that a document repeats are one row with all places
                    u, w, at = u[order], w[order], at[order]
                    new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    rest = np.ones(len(w), bool)
                    rest[new] = False
                    passages.append((u[new], w[new], np.full(len(new), rid), np.full(len(new), k), at[new], np.diff(np.r_[new, len(w)]) - 1, at[rest]))
                held += int(n.sum())
                if held > 1 << 17:
                    if shingles:
                        yield sets(shingles)
                    if passages:
                        yield parts(passages)
                    shingles, passages, held = [], [], 0
            if shingles:
                yield sets(shingles)
            if passages:
                yield parts(passages)

    ask = lambda df, line: df.select("rid", F.struct("u", "at", "n", F.lit(line).alias("line")).alias("a"))
    mixed = kinds.where("mixed").select("u").distinct()
    own = ask(met.where("again").join(mixed, "u", "left_semi"), False)
    wanted = ask(places, True).unionByName(ask(kinds.where("mixed"), False)).unionByName(own).distinct().groupBy("rid").agg(F.collect_list("a").alias("asks"))
    near = maybe_in(docs, "rid", id_filter(wanted, "rid")).where("_hit").select("rid", "k", "t")
    held = near.join(wanted, "rid").dropDuplicates(["rid"]).select("rid", "k", "t", "asks")
    return put(held.mapInArrow(run, kind), "paragraph-details")


def _alike(sets: list, asked, similarity: float):
    """Pairs (i, j) of sets with at least this Jaccard similarity, i asked, through an inverted index; each pair once."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return (np.array([0]), np.array([1])) if both >= similarity * (sizes.sum() - both) - 1e-9 else (np.zeros(0, int),) * 2
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    rows, cut = owner[order], np.r_[0, np.bincount(code).cumsum()]
    start = np.r_[0, sizes.cumsum()]
    a, b = [], []
    for i in np.flatnonzero(asked).tolist():
        own = code[start[i] : start[i + 1]]
        both = np.bincount(np.concatenate([rows[cut[c] : cut[c + 1]] for c in own]), minlength=len(sets))
        j = np.flatnonzero(both >= similarity * (sizes[i] + sizes - both) - 1e-9)
        j = j[(j > i) | ~asked[j]]
        a.append(np.full(len(j), i))
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def _compared(cells: DataFrame, similarity: float) -> DataFrame:
    """cells (cell, u, s, asked) -> links (a, b) of lines of one cell, of which one at least is asked."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def links(keys, us, asked, sets):
            a, b = [], []
            bounds = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
            for i, j in zip(bounds, bounds[1:], strict=False):
                if j - i > 1 and asked[i:j].any():
                    x, y = _alike(sets[i:j], asked[i:j], similarity)
                    a.append(us[i:j][x])
                    b.append(us[i:j][y])
            pair = _forest(np.concatenate(a), np.concatenate(b)) if sum(map(len, a)) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], names=["a", "b"])

        kept = None  # the last cell's rows so far: keys, us, asked, and sets by batch
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            sets = np.split(batch.column(3).flatten().to_numpy(), batch.column(3).value_lengths().to_numpy().cumsum()[:-1])
            if kept is not None:
                now, sets = [np.concatenate(x) for x in zip(kept[0], now, strict=True)], kept[1] + sets
            at = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if at:
                yield links(*(x[:at] for x in now), sets[:at])
                now, sets = [x[at:] for x in now], sets[at:]
            kept = (now, sets)
        if kept is not None and len(kept[0][0]):
            yield links(*kept[0], kept[1])

    dealt = cells.select("cell", "u", "asked", "s").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _colliding(lines: DataFrame, put: Tables) -> tuple[DataFrame, DataFrame]:
    """A written table of lines that share a band (key, u, c: the band's lines), and a place (u, rid, at, n) of each."""
    one = lines.groupBy("u").agg(*(F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)))
    keyed = one.select("u", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = put(keyed.join(shared, "key"), "band-members")
    asked = members.select("u").distinct()
    near = maybe_in(lines.select("u", "rid", "at", "n"), "u", id_filter(asked, "u")).where("_hit")
    places = near.groupBy("u").agg(F.min(F.struct("rid", "at", "n")).alias("p"))  # first, so that a common line is one row when it is joined
    return members, places.join(asked, "u", "left_semi").select("u", "p.*")


def _near_links(members: DataFrame, sets: DataFrame, similarity: float, put: Tables) -> DataFrame:
    """Links (a, b) between distinct lines' hashes: enough to connect all of at least this similarity.

    A group of at most CHUNK lines is one cell. In a larger one each line is compared with the group's least (in the
    JVM, so a hot group is split like any skewed join); lines like it are linked and done with each other; each
    other line meets the whole group, chunk against chunk.
    """
    few = members.where(f"c <= {CHUNK}").join(sets, "u").select(F.col("key").alias("cell"), "u", "s", F.lit(True).alias("asked"))
    hot = members.where(f"c > {CHUNK}").join(sets, "u")
    head = members.where(f"c > {CHUNK}").groupBy("key").agg(F.min("u").alias("h")).join(sets.select(F.col("u").alias("h"), F.col("s").alias("hs")), "h")
    both = F.size(F.array_intersect("s", "hs"))
    near = both >= F.lit(similarity) * (F.size("s") + F.size("hs") - both) - F.lit(1e-9)
    told = put(hot.join(head, "key").select("key", "u", "h", "s", "c", near.alias("near")), "band-hot")
    star = told.where("near and u <> h").select(F.col("u").alias("a"), F.col("h").alias("b"))
    left = told.groupBy("key").agg(F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("r")).where("r > 0")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("u"), chunks(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    spread = told.join(left, "key")
    asking = spread.where("not near").select("key", "u", "s", own("r").alias("i"), all_of("c").alias("j"), F.lit(True).alias("asked"))
    others = spread.select("key", "u", "s", all_of("r").alias("i"), own("c").alias("j"), F.lit(False).alias("asked"))
    crowd = asking.unionByName(others).select(F.xxhash64("key", "i", "j").alias("cell"), "u", "s", "asked")
    found = _compared(few.unionByName(crowd), similarity).where("a <> b").unionByName(star)
    return put(found.distinct(), "line-links")


def _line_copies(lines: DataFrame, reached: DataFrame, put: Tables) -> DataFrame:
    """Lines (rid, at, n, cls, first) of classes with more than one occurrence; first is the smallest document."""
    own = lines.groupBy("u").agg(F.count("*").alias("c"), F.min("k").alias("first")).join(reached.withColumnRenamed("node", "u"), "u", "left")
    own = own.select("u", "c", "first", F.coalesce("component", "u").alias("cls"))
    all_of = own.groupBy("cls").agg(F.sum("c").alias("c"), F.min("first").alias("first")).where("c > 1").select("cls", "first")
    known = put(own.select("u", "cls").join(all_of, "cls"), "line-classes")
    near = maybe_in(lines.select("rid", "at", "n", "u"), "u", id_filter(known, "u")).where("_hit").select("rid", "at", "n", "u")
    return near.join(known, "u").select("rid", "at", "n", F.lit(None).cast("int").alias("own"), "cls", "first")


def _passage_copies(met: DataFrame, kinds: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Stretches of copied passages (rid, at, n words, own, cls null, first). own: where the first one begins, if in the same document."""
    there = [F.col(c).alias(f"f_{c}") for c in ("k", "rid", "at")]
    away = "not (rid = f_rid and at = f_at)"
    own = F.when(F.col("rid") == F.col("f_rid"), F.col("f_at")).alias("own")
    told = lambda df, n: df.where(away).select("rid", "at", n, own, F.lit(None).cast("bigint").alias("cls"), F.col("f_k").alias("first"))
    whole = met.join(kinds.where("c > 1").select("u", "g", "mixed", *there), ["u", "g"]).where("not (mixed and rid = f_rid)")
    alone = parts.groupBy("w").agg(F.count("*").alias("c"), F.max(F.size("more")).alias("m")).where("c > 1 or m > 0").select("w")
    met = maybe_in(parts.drop("s"), "w", id_filter(alone, "w")).where("_hit").drop("_hit")  # most others stay where they are
    firsts = met.groupBy("u", "w").agg(F.min(F.struct("k", "rid", "at")).alias("p"), F.count("*").alias("c"), F.max(F.size("more")).alias("m"))
    firsts = firsts.where("c > 1 or m > 0").select("u", "w", "p.*").select("u", "w", *there)
    single = met.join(firsts, ["u", "w"]).withColumn("at", F.explode(F.concat(F.array("at"), "more")))
    return told(whole, (F.col("n") + F.lit(least - 1)).cast("int").alias("n")).unionByName(told(single, F.lit(least).alias("n")))


def cut_out(text: str, at, size, own, cls, line, first, key: int, least: int) -> tuple[str, int, int, list[int]]:
    """The text without its removed stretches; stretches, words and first documents of what went.

    Arrays, a row a paragraph: place, words, place of the first one if here (else -1), class if a line, first document.
    """
    import numpy as np

    words = [m.span() for m in WORD.finditer(text)]
    n = len(words)

    def cover(some, begin):
        return (np.bincount(begin[some], minlength=n + 1) - np.bincount(begin[some] + size[some], minlength=n + 1)).cumsum()[:n] > 0

    goes, stays, order = np.ones(len(at), bool), {}, np.argsort(at, kind="stable")
    for i in order[line[order]].tolist():  # of a class whose first document is this one, the first line stays
        if first[i] == key and stays.setdefault(cls[i], at[i]) == at[i]:
            goes[i] = False
    here = ~line & (own >= 0)
    gone = cover(goes & ~here, at) | cover(here, at) & ~cover(here, own)
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
    runs = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]
    if not runs:
        return text, 0, 0, []
    out, begin, kept = [], 0, np.zeros(n + 1, np.int64)
    for a, b in runs:
        out.append(text[begin : words[a][0]])
        begin = words[b][0] if b < n else len(text)
        kept[a + 1 : b + 1] = 1
    out.append(text[begin:])
    kept = kept.cumsum()
    hit = goes & (kept[at + size] > kept[at])
    return "".join(out), len(runs), sum(b - a for a, b in runs), np.unique(first[hit]).tolist()


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 25, similarity: float = 0.8) -> DataFrame:
    """df's rows, text rewritten, with _stretches and _words removed and _firsts, the documents that keep them.

    Where df has columns of these names, ours get an underscore more.
    """
    rid = F.xxhash64(F.col(key).cast("long"), text_of(text))
    docs = df.select(rid.alias("rid"), F.col(key).cast("long").alias("k"), text_of(text).alias("t")).where("k is not null")
    put = Tables(df.sparkSession)
    lines, passages = _cut(docs, least, put)
    members, places = _colliding(lines, put)
    met, kinds = _collisions(passages, least, put)
    details = _details(docs, places, met, kinds, least, put)
    links = _near_links(members, details.where("s is not null").select("u", "s"), similarity, put)
    copies = _line_copies(lines, components(links), put).unionByName(_passage_copies(met, kinds, details.where("s is null"), least))
    row, found, hit = (fresh(x, df.columns) for x in ("_rid", "_found", "_hit"))
    facts = F.struct("at", "n", "own", "cls", "first")
    asks = materialise(copies.groupBy(F.col("rid").alias(row)).agg(F.collect_list(facts).alias(found)), "paragraph-removals")
    put.drop()  # what follows needs the removals only
    marked = maybe_in(df.withColumn(row, rid), row, id_filter(asks, row), hit)
    added = [fresh(x, df.columns) for x in ADDED]
    none = [F.lit(0).alias(added[0]), F.lit(0).alias(added[1]), F.array().cast("array<bigint>").alias(added[2])]
    still = marked.where(~F.col(hit)).select(*df.columns, *none)
    names, at, kinds_of = df.columns, df.columns.index(text), dict(df.dtypes)
    key_at = df.columns.index(key)

    def rewrite(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            asked = b.column(len(names))
            ends = np.r_[0, asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()]
            place, size, own, cls, first = asked.flatten().flatten()
            line = cls.is_valid().to_numpy(zero_copy_only=False)
            flat = [x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (place, size, own, cls)] + [line, first.to_numpy(zero_copy_only=False)]
            texts, extra = [], ([], [], [])
            for i, (k, t) in enumerate(zip(b.column(key_at).to_pylist(), b.column(at).to_pylist(), strict=True)):
                x, y = ends[i], ends[i + 1]
                new, *facts = cut_out(t, *(c[x:y] for c in flat), int(k), least) if y > x and t and k is not None else (t, 0, 0, [])
                texts.append(new)
                for one, v in zip(extra, facts, strict=True):
                    one.append(v)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(extra[0], pa.int32()), pa.array(extra[1], pa.int32()), pa.array(extra[2], pa.list_(pa.int64()))], names=[*names, *added])

    schema = ", ".join(f"`{c}` {kinds_of[c]}" for c in names) + ", {} int, {} int, {} array<bigint>".format(*added)
    changed = marked.where(hit).join(asks, row, "left").select(*names, found).mapInArrow(rewrite, schema)
    return still.unionByName(changed)


def classes(result: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """dedup()'s rows, key, class_id (smallest document reachable through removed stretches), links, stretches, words, text."""
    rows = materialise(result.select(F.col(key), F.col(key).cast("long").alias("_k"), "_firsts", "_stretches", "_words", F.col(text).alias("_text")), "substring-dedup")
    edges = rows.where("_k is not null").select(F.col("_k").alias("a"), F.explode("_firsts").alias("b"))
    reached = components(edges)
    joined = rows.join(reached.withColumnRenamed("node", "_k"), "_k", "left")
    return joined.select(
        key, F.coalesce("component", "_k").alias("class_id"), F.size(F.array_remove("_firsts", F.col("_k"))).alias("n_links"), F.col("_stretches").alias("n_removed"),
        F.col("_words").alias("removed_words"), F.col("_text").alias("kept_text"),
    )
