"""Approximate nearest neighbours by balanced posting lists.

Fit: a bounded sample is halved again and again at the median between two centres, so every leaf holds
equally many vectors; the leaves' means are the centroids, joined in a small navigable graph (nearest
neighbours plus far links) that every task keeps in memory and searches by a beam. Index: every vector goes
to its nearest centroid's list, and, near a boundary, also to others whose distance is within `replicate` of
the nearest, unless a centroid already chosen is nearer to that one than the vector is. Search: a query
reads the lists whose centroid distance is within `prune` of its nearest, `beam` at most.

There is one way for tables of every size. A graph holds at most CENTROIDS lists; beyond CENTROIDS times `list_size`
vectors the lists grow, and a query still reads its `beam` nearest, so the share of the table that it may read, and with it
the recall, does not fall as tables grow. Lists and their queries meet in chunks: no task holds more than two. The price is
that a query's work grows with its lists (README).

Copies of one vector are one index row with their smallest keys, as many as could ever be returned. Of equal
scores the smaller keys count, however many tie.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite parts take no part, null keys
neither; a vector is near those of its own length only; rows that repeat key and vector are one; fewer candidates
than `k` give all; an empty table gives an empty one. Executors get plain arrays and functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small

#: Bounds of what one task or the driver holds: sampled vectors and centroids, at any size of table.
SAMPLE, CENTROIDS = 16_384, 1_024
#: Nearest lists among which a vector's boundary copies are chosen.
CELLS = 8


def graph_of(centroids, degree: int = 24, far: int = 4) -> tuple:
    """Centroids (unit rows), their graph's links, and where searches enter it."""
    import numpy as np

    n = len(centroids)
    sims = centroids @ centroids.T
    np.fill_diagonal(sims, -2)
    near = np.argsort(-sims, axis=1, kind="stable")[:, : min(degree, max(1, n - 1))] if n > 1 else np.zeros((n, 1), int)
    rng = np.random.default_rng(5)
    return centroids, np.concatenate([near, rng.integers(0, n, (n, far))], axis=1), np.unique(np.linspace(0, n - 1, min(n, 24)).astype(int))


def search(graph: tuple, x, beam: int):
    """(ids, similarities) of about the `beam` best centroids of each row, best first."""
    import numpy as np

    centroids, links, entry = graph
    n = len(centroids)
    beam = min(beam, n)
    rows = np.arange(len(x))[:, None]
    sims = np.full((len(x), n), -2.0, np.float32)  # similarities seen so far
    sims[:, entry] = x @ centroids[entry].T
    done = np.zeros((len(x), n), bool)
    for _ in range(64):
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam] if beam < n else np.broadcast_to(np.arange(n), (len(x), n))
        fresh = ~done[rows, best] & (sims[rows, best] > -2)
        if not fresh.any():
            break
        order = np.argsort(-np.where(fresh, sims[rows, best], -3), axis=1)[:, :4]  # widen the four best first
        pick = np.take_along_axis(best, order, axis=1)
        live = np.take_along_axis(fresh, order, axis=1)
        r, c = np.nonzero(live)
        done[r, pick[r, c]] = True
        to = links[pick[r, c]]
        r = np.repeat(r, to.shape[1])
        to = to.ravel()
        new = sims[r, to] == -2
        r, to = r[new], to[new]
        if len(r):
            sims[r, to] = np.einsum("ij,ij->i", x[r], centroids[to])
    ids = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    return ids, sims[rows, ids]


def centroids_of(sample, count: int):
    """Means of the leaves of balanced halving, as unit rows."""
    import numpy as np

    def halve(x, count, rng):
        if count <= 1 or len(x) < 2:
            return [x.mean(axis=0)]
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            side = x @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = (y / max(np.linalg.norm(y), 1e-12) for y in (x[side].mean(axis=0), x[~side].mean(axis=0)))
        order = np.argsort(x @ (a - b), kind="stable")
        left = count // 2
        at = len(x) * left // count
        return halve(x[order[:at]], left, rng) + halve(x[order[at:]], count - left, rng)

    out = np.array(halve(sample, min(count, len(sample)), np.random.default_rng(3)), np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def dense(column, width: int):
    """An Arrow column of number lists as rows of `width` numbers; shorter ones end in zeros, longer ones are cut."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(float)
    out = np.zeros((len(sizes), width))
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def unit(v):
    """Rows as unit vectors of single precision; zero rows stay."""
    import numpy as np

    big = np.abs(v).max(axis=1, keepdims=True, initial=0)
    v = v / np.where(big > 0, big, 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def lists_of(graph: tuple, x, widest: int, ratio: float, copies: int):
    """(rows, lists): lists within ratio of a row's nearest centroid's distance; copies (if above 0): at most so many, thinned."""
    import numpy as np

    ids, sims = search(graph, x, widest)
    far = np.sqrt(np.maximum(2 - 2 * sims.astype(float), 0))
    take = far <= ratio * far[:, :1] + 1e-6
    for j in range(1, ids.shape[1] if copies else 0):  # none for queries
        between = np.einsum("ijk,ik->ij", graph[0][ids[:, :j]], graph[0][ids[:, j]])
        apart = np.sqrt(np.maximum(2 - 2 * between, 0))
        take[:, j] &= ~((apart < far[:, j : j + 1]) & take[:, :j]).any(axis=1) & (take[:, :j].sum(axis=1) < copies)
    take[:, 0] = True
    r, c = np.nonzero(take)
    return r, ids[r, c]


def best_of(queries, qid, vectors, ids, k: int):
    """(query, id, score) of each query's k best rows by (score, smallest id), its own key aside. ids: Arrow lists of keys."""
    import numpy as np

    qn, vn = (np.sqrt((y * y).sum(axis=1)) for y in (queries, vectors))
    many, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
    begin, out = many.cumsum() - many, []
    for s in range(0, len(queries), 256):
        rough = (queries[s : s + 256] @ vectors.T) / np.outer(qn[s : s + 256], vn)
        top = min(k + 1, rough.shape[1])  # one may be the query itself
        least = np.partition(rough, rough.shape[1] - top, axis=1)[:, -top] - 1e-9
        q, v = np.nonzero(rough >= least[:, None])
        exact = np.concatenate([(vectors[v[i : i + 8192]] * queries[s + q[i : i + 8192]]).sum(axis=1) for i in range(0, len(q), 8192)]) / (qn[s + q] * vn[v])
        each = many[v]
        one = flat[np.arange(each.sum()) - np.repeat(each.cumsum() - each, each) + np.repeat(begin[v], each)]
        who, score = qid[s + np.repeat(q, each)], np.repeat(exact, each)
        fine = one != who
        who, one, score = who[fine], one[fine], score[fine]
        order = np.lexsort((one, -score, who))
        who, one, score = who[order], one[order], score[order]
        new = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
        rank = np.arange(len(who)) - np.repeat(new, np.diff(np.r_[new, len(who)]))
        out.append([x[rank < k] for x in (who, one, score)])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v, d (its length) of the rows that take part."""
    v = F.col("v")
    good = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    good = good.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return good.withColumn("d", F.size("v"))


def nearest(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
    list_size: int = 128, replicate: float = 1.06, copies: int = 4, prune: float = 1.35, beam: int = 128, chunk: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for keys divisible by `every`, the k nearest others by cosine."""
    import numpy as np

    spark = df.sparkSession
    own = usable(df, key, vector)
    per_copy = W.partitionBy("v").orderBy("id")
    kept = own.distinct().withColumn("n", F.row_number().over(per_copy)).where(F.col("n") <= k + 1)
    classes = materialise(kept.groupBy("v", "d").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    rows = classes.count()
    sampled = classes.orderBy(F.xxhash64(F.element_at("ids", 1), "v")).limit(SAMPLE).select("v", "d").collect()
    if not sampled:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = sorted(r["d"] for r in sampled)
    width = max(set(sizes), key=lambda d: (sizes.count(d), -d)) if sizes[0] != sizes[-1] else sizes[0]
    x = unit(np.array([(r["v"] + [0.0] * width)[:width] for r in sampled]))
    lists = int(min(CENTROIDS, max(1, len(x) // 8), -(-rows // list_size)))
    held = spark.sparkContext.broadcast(graph_of(centroids_of(x, lists)))  # plain arrays, at most CENTROIDS rows

    def assign(widest: int, ratio: float, most: int):
        """Adds `list`, one row for each list: within ratio of the nearest centroid's distance."""

        def run(batches):
            import pyarrow as pa

            for whole in batches:
                for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                    r, c = lists_of(held.value, unit(dense(b.column(1), width)), widest, ratio, most)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(r)).columns, pa.array(c.astype(np.int64))], names=[*b.schema.names, "list"])

        return run

    postings = classes.select("ids", "v", "d").mapInArrow(assign(CELLS, replicate, copies), "ids array<bigint>, v array<double>, d int, list bigint")
    asked = own.where(F.col("id") % every == 0).distinct().select("id", "v", "d")
    wanted = asked.mapInArrow(assign(beam, prune, 0), "id bigint, v array<double>, d int, list bigint")
    postings, wanted = materialise(postings, "ann-lists"), materialise(wanted, "ann-queries")
    places = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    both = small(materialise(places(postings, "parts").join(places(wanted, "turns"), "list"), "ann-places"))
    none = lambda kind: F.lit(None).cast(kind)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.pmod(F.xxhash64(c), F.lit(1000003)), F.col(n)).cast("int")
    left = postings.join(both, "list").select("list", part("ids", "parts").alias("part"), all_of("turns").alias("turn"), none("bigint").alias("q"), "ids", "v", "d")
    right = wanted.join(both, "list").select("list", all_of("parts").alias("part"), part("id", "turns").alias("turn"), F.col("id").alias("q"), none("array<bigint>").alias("ids"), "v", "d")

    def compare(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        asking = t.column("q").is_valid()
        queries, index = t.filter(asking), t.filter(pc.invert(asking))
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and index.num_rows:
            d = t.column("d")[0].as_py()
            out = best_of(dense(queries.column("v"), d), queries.column("q").to_numpy(), dense(index.column("v"), d), index.column("ids").combine_chunks(), k)
        return pa.table({n: pa.array(x) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.unionByName(right).groupBy("list", "part", "turn", "d").applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
