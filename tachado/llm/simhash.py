"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most three bits, one half
differs in at most one; so each half is indexed 32 times, each time with one bit blanked, and both
fingerprints meet under the variant that blanks their differing bit (any variant, if the half is equal).
Fingerprints that meet are compared in full. Equal fingerprints are one node throughout, so copies never
multiply; of the links found in one batch of variant groups only a spanning forest goes on, so a group
of m fingerprints gives fewer than m rows, while every link's ends stay connected.

A variant group of more than GROUP fingerprints is not one task's: its members meet anew by that variant and one
of four segments of the other half (two that differ in at most three bits there agree in one of four segments),
and what is still larger meets chunk against chunk; so no link is lost, and no task holds more than two chunks.

Defined cases: a null text is empty; texts without a word have fingerprint zero, linked like any other;
a row with a null key links others like any row and gets the smallest known key of its component (null if none is
known); repeated rows each get a row; columns to carry may have any names but fp, component_id and the
key's; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, text_of
from .components import components

SEED, WIDTH, HALF = 42, 64, 32
#: Most fingerprints of a variant group that one task compares with each other.
GROUP = 4096


def fingerprint(text: str, shingle: int = 3) -> int:
    """Lower-case A-Z, words between ASCII white space, shingles (or the whole sequence), XXH64, majority bits."""
    return _fingerprints([text], shingle)[0]


def _fingerprints(texts: list[str], shingle: int) -> list[int]:
    import numpy as np
    from xxhash import xxh64_intdigest

    out = []
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for text in texts:
        words = text.encode().lower().split()
        if not words:
            out.append(0)
            continue
        total, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
        if len(words) < shingle:
            grams = iter([b" ".join(words)])
        else:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        for at in range(0, n, 16384):  # bounded memory for very long texts
            m = min(16384, n - at)
            h = np.fromiter((xxh64_intdigest(next(grams), SEED) for _ in range(m)), np.uint64, m)
            bits = np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
        out.append(int((weights * (2 * total > n)).sum()))
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to carry, fp: the fingerprint as a signed 64-bit number."""
    k, t = fresh("_k", [*carry, "fp"]), fresh("_t", [*carry, "fp"])
    names = [k, *carry, "fp"]

    def compute(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array(_fingerprints(b.column(1).to_pylist(), shingle), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fps, pa.int64())], names=names)

    own = df.select(F.col(key).alias(k), text_of(text).alias(t), *carry)
    kinds = {**dict(own.dtypes), "fp": "bigint"}
    return own.mapInArrow(compute, ", ".join(f"`{c}` {kinds[c]}" for c in names)).withColumnRenamed(k, key)


def _forest(a, b):
    """Of links a-b (numpy arrays), those of a spanning forest: each node to the smallest it reaches."""
    import numpy as np

    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            moved = low != np.arange(len(nodes))
            return nodes[moved], nodes[low[moved]]
        low = new


def _linked(key, fp, node, bits: int, block: int = 2048):
    """Links between rows of equal key (sorted) whose fingerprints differ in at most `bits` bits."""
    import numpy as np

    fp = fp.view(np.uint64)  # counts of a signed number's bits are those of its magnitude
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    few = np.repeat(size, size) <= 32
    for d in range(1, int(min(32, size.max(initial=0)))):
        i = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
        a.append(node[i])
        b.append(node[i + d])
    for s, n in zip(start[size > 32], size[size > 32], strict=True):
        for p in range(s, s + n, block):
            for q in range(p, s + n, block):
                i, j = np.nonzero(np.bitwise_count(fp[p : min(p + block, s + n), None] ^ fp[None, q : min(q + block, s + n)]) <= bits)
                keep = i + p < j + q
                x, y = _forest(node[i[keep] + p], node[j[keep] + q])
                a.append(x)
                b.append(y)
    return _forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def _groups(batches, bits: int, most: int | None):
    """Arrow batches (key, fp, node), sorted by key -> batches (a, b, key): links, and of groups above `most` the members (a: fp, b: node)."""
    import numpy as np
    import pyarrow as pa

    def batch(a, b, key=None):
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), keys], names=["a", "b", "key"])

    def linked(rows):
        if len(rows[0]):
            yield batch(*_linked(*rows, bits))

    kept, large = None, None  # the last group so far; the key of one that is too large
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if large is not None:
            n = int(np.searchsorted(now[0], large, side="right"))
            yield batch(now[1][:n], now[2][:n], now[0][:n])
            now = [x[n:] for x in now]
        rows = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
        if not len(rows[0]):
            continue
        large = None
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from linked([x[:cut] for x in rows])
        kept = [x[cut:] for x in rows]
        if most is not None and len(kept[0]) > most:
            yield batch(kept[1], kept[2], kept[0])
            large, kept = int(kept[0][0]), None
    if kept is not None:
        yield from linked(kept)


def _meet(rows: DataFrame, bits: int, most: int | None) -> DataFrame:
    """rows (key, fp, node) -> (a, b, key): see _groups."""
    # A group that ends inside a batch is compared there: its rows are at most a batch and what was kept.
    return rows.select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _groups(batches, bits, most), "a bigint, b bigint, key bigint")


def links(nodes: DataFrame, bits: int = 3, most: int = GROUP) -> DataFrame:
    """nodes (fp, node), one row a fingerprint -> links (a, b) between nodes, enough to connect all within `bits`."""
    if bits > 3:
        raise ValueError("two segments of one-bit variants are complete up to three bits")
    variants = (
        nodes.select("fp", "node", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
        .withColumn("bit", F.expr("v % 32"))
        .select(
            F.expr("shiftleft(cast(v as bigint), 32) | (shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295L & ~shiftleft(1L, bit))").alias("key"),
            "fp",
            "node",
        )
    )
    met = materialise(_meet(variants, bits, most), "simhash-links")
    found = met.where("key is null").select("a", "b")
    large = met.where("key is not null").select(F.col("a").alias("fp"), F.col("b").alias("node"), "key")
    if not large.limit(1).count():
        return found.distinct()
    # The half that the variant is not of (variants of the lower half have keys below 32 << 32), by segments of 8 bits.
    other = F.expr("shiftrightunsigned(fp, if(key < 137438953472L, 32, 0)) & 4294967295L")
    split = large.withColumn("half", other).withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(3))))
    split = split.withColumn("sub", F.xxhash64("key", "seg", F.expr("shiftrightunsigned(half, 8 * seg) & 255L")))
    sizes = split.groupBy("sub").agg(F.ceil(F.count("*") / most).cast("int").alias("c"))
    split = materialise(split.join(sizes, "sub").select("sub", "fp", "node", "c"), "simhash-large")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    cells = split.withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cells = cells.select(F.xxhash64("sub", F.least("own", "j"), F.greatest("own", "j")).alias("key"), "fp", "node")
    return found.unionByName(_meet(cells, bits, None).select("a", "b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 3, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to carry, fp, component_id: the smallest key reachable by links of at most `bits` differing bits."""
    marked = materialise(fingerprints(df, key, text, carry=carry), "simhash")
    known = marked.groupBy("fp").agg(F.min(F.col(key).cast("long")).alias("least"))
    reached = components(links(known.select("fp", F.col("fp").alias("node")), bits)).withColumnRenamed("node", "fp")
    placed = known.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left").select(key, *carry, "fp", "component_id")
