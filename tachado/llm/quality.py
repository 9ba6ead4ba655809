"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts; keys, languages, sources and labels are never inputs. The trees are
grown level by level on at most `bins` histogram bins a statistic, then flattened into arrays of one
complete tree each, so scoring a batch is `depth` numpy steps for all trees at once.

The fit reads at most SAMPLE labelled rows (chosen by a hash of the key, so the same at any layout) that
are not held out; scoring covers every row.

Defined cases: a null or empty text is scored by its (zero) statistics; without usable labels, or with
labels of one kind only, every score is the base rate (0.5 without any); rows repeated among documents or
labels count as often as they stand; null labels and null keys are not learned from; an empty table gives
an empty one.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

#: Most labelled rows that a model is fitted on.
SAMPLE = 20_000
STATISTICS = (
    "log_chars log_words word_length upper lower digit space newline bar exclaim symbols punctuation other unique_words top_word same_as_last "
    "short_words long_words longest_word repeated_lines line_words sentence_words squeeze capitals symbol_ends"
).split()


def statistics(text: str) -> list[float]:
    import numpy as np

    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words, lines = len(raw), text.split(), text.split("\n")
    m = max(1, len(words))
    upper, lower, digit = int(n[65:91].sum()), int(n[97:123].sum()), int(n[48:58].sum())
    spaces, symbols = int(n[9:14].sum() + n[32]), int(n[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum())
    ends = int(n[[46, 63]].sum())
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    distinct, top = len(counts), max(counts.values(), default=0)
    repeats = sum(map(operator.eq, words, words[1:]))
    held = [x for x in lines if x]
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()), upper / size, lower / size, digit / size, spaces / size, int(n[10]) / size,
        int(n[124]) / size, int(n[33]) / size, symbols / size, ends / m, int(n[128:].sum()) / size, distinct / m, top / m, repeats / m,
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), float(lengths.max()), 1 - len(set(held)) / max(1, len(held)), m / max(1, len(held)), m / (ends + 1),
        len(zlib.compress(raw, 1)) / size, sum(c for w, c in counts.items() if w.isupper()) / m, sum(c for w, c in counts.items() if not w[-1].isalnum()) / m,
    ]


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns and stats, an array<double> of whole-text statistics."""

    def compute(batches):
        import pyarrow as pa

        for b in batches:
            stats = [statistics(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    own = df.select(*keep, text_of(text).alias("_text"))
    kinds = dict(own.dtypes)
    return own.mapInArrow(compute, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", stats array<double>")


class Trees:
    """Complete trees of `depth` levels in arrays: feature and threshold by (tree, inner node), value by (tree, leaf)."""

    def __init__(self, base, feature, threshold, value, depth):
        self.base, self.feature, self.threshold, self.value, self.depth = base, feature, threshold, value, depth

    def margin(self, x):
        import numpy as np

        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return out + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x, y, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 5.0) -> Trees:
    """Histogram boosting for log loss. x: rows by statistics, y: 0 or 1."""
    import numpy as np

    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    feature, threshold, value = (np.zeros((trees, n), t) for n, t in ((inner, np.int64), (inner, float), (leaves, float)))
    margin = np.full(len(y), base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, choice = np.zeros(width), [(0, np.inf, bins)] * width
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j in range(k):
                cell = local * bins + binned[:, j]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                gr, hr = total_g[:, None] - gs, total_h[:, None] - hs
                gain = gs**2 / (hs + smooth) + gr**2 / (hr + smooth) - (total_g**2 / (total_h + smooth))[:, None]
                gain[(hs < least / 4) | (hr < least / 4)] = -1
                gain[:, len(edges[j]) :] = -1
                at = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), at] > best + 1e-9):
                    best[w], choice[w] = gain[w, at[w]], (j, edges[j][at[w]], int(at[w]))
            cut = np.array([c[2] for c in choice])
            chosen = np.array([c[0] for c in choice])
            feature[t, first : first + width] = chosen
            threshold[t, first : first + width] = [c[1] for c in choice]
            node = 2 * node + 1 + (binned[np.arange(len(y)), chosen[local]] > cut[local])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        margin += value[t][leaf]
    return Trees(base, feature, threshold, value, depth)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fits on at most `sample` labelled rows that are not held out, by a hash of key, label and text."""
    import numpy as np

    usable = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y in (0, 1)").where(~held_out("_k"))
    chosen = usable.orderBy(F.xxhash64("_k"), "_k", "_y").limit(sample)
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").withColumn("_h", F.xxhash64("_k", "_y", "_t"))
    rows = with_statistics(own, ["_k", "_y", "_h"], "_t").orderBy("_h", "_k", "_y").limit(sample).collect()
    rows.sort(key=lambda r: (r["_k"], r["_y"], r["stats"]))
    x = np.array([r["stats"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["_y"] for r in rows], float))


def scores(docs: DataFrame, model: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns, _score (0 to 1) and _predicted (1 from 0.5 on), named anew where keep has these names."""
    apart, added = text not in keep, [fresh("_score", keep), fresh("_predicted", keep)]

    def compute(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at = len(keep) if apart else keep.index(text)
            stats = np.array([statistics(t or "") for t in b.column(at).to_pylist()], float).reshape(b.num_rows, len(STATISTICS))
            s = np.concatenate([model.score(stats[i : i + 1024]) for i in range(0, len(stats), 1024)]) if len(stats) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, *added])

    own = docs.select(*keep, *([text_of(text).alias("_text")] if apart else []))
    kinds = dict(own.dtypes)
    return own.mapInArrow(compute, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {added[0]} double, {added[1]} int")
