"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A text's terms are its words between ASCII white space, weighted by how often they occur. For sample i and
term t a hash gives r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1); with weight w the term's level is
floor(ln w / r + b), and its rank a = c * exp(-r * (level - b + 1)). The sample is the least rank: it
depends on term and level only, so two texts have the same sample with the probability of their generalised
Jaccard similarity (sum of least weights over sum of greatest). r and b are shared by SHARE
neighbouring samples, which leaves each sample's law as it is and saves logarithms.

The document order (descending key, then a hash of the text; after the last the first) is cut into ranges in two
steps. At most BOUNDS quantiles of a sample of the keys cut it into sections, so far-off keys change little; a key
that is several quantiles is a section of its own, and so are the null keys. A section is cut into ranges of about
RANGE documents or CHARS characters by arithmetic: on the key, or, where all keys are equal, on the hash. Each
range also gets the next range's first document, so "the next document" is a lead inside a range and no task sorts
all documents. Texts are shuffled once, by range; the sections' facts are a few arrays in the plan.

Defined cases: null texts are empty; texts without words have the fingerprint of zeros and are like each
other (1) and unlike others (0); null keys come last; rows with equal keys follow each other by a hash of
their text; with one document the next is itself; the key and text columns may have any names, others are not
looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_filter, materialise, maybe_in, small, text_of

#: Samples in all, neighbouring samples that share r and b, and samples handled in one row.
SAMPLES, SHARE, GROUP = 64, 2, 8
#: Documents and characters in a range of the order, at most so many sections, and sampled keys for each.
RANGE, CHARS, BOUNDS, SAMPLED = 256, 1 << 20, 4096, 32
SPACE = r"[\x20\x09-\x0D]+"


def _bits(h: Column, at: int, width: int) -> Column:
    """Bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def ranks(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES, share: int = SHARE, group: int = GROUP) -> DataFrame:
    """terms (keys, term long, weights) -> keys, g (group), and for weight j and sample i of the group a_j_i: the least rank."""
    wide = terms.select(*keys, "term", *(F.when(F.col(w) > 0, F.ln(w)).alias(w) for w in weights), F.explode(F.sequence(F.lit(0), F.lit(samples // group - 1))).alias("g"))
    sets, first, others = range(group // share), weights[0], weights[1:]
    salt = lambda i: F.lit(int.from_bytes(hashlib.sha256(b"sample %d" % i).digest()[:7], "little"))
    base = F.col("term").bitwiseXOR(F.shiftleft(F.col("g").cast("long"), 56))
    hashed = wide.select(*keys, "g", base.alias("base"), *weights)
    hashed = hashed.select(*keys, "g", "base", *weights, *(F.xxhash64(F.col("base").bitwiseXOR(salt(group + s))).alias(f"h{s}") for s in sets))
    drawn = hashed.select(
        *keys, "g", "base", *weights, *(_bits(F.col(f"h{s}"), 42, 22).alias(f"b{s}") for s in sets),
        *((-F.ln(_bits(F.col(f"h{s}"), 0, 21) * _bits(F.col(f"h{s}"), 21, 21))).alias(f"r{s}") for s in sets),
    )
    r, b = (lambda s: F.col(f"r{s}")), (lambda s: F.col(f"b{s}"))
    scale = lambda w, s: F.exp(-r(s) * (F.floor(F.col(w) / r(s) + b(s)) - b(s) + 1))
    scaled = drawn.select(
        *keys, "g", *weights, *(x for s in sets for x in (r(s), b(s))), *(scale(first, s).alias(f"{first}{s}") for s in sets),
        *(F.xxhash64(F.col("base").bitwiseXOR(salt(i))).alias(f"h{i}") for i in range(group)),
    )
    ready = scaled.select(
        *keys, "g", *(f"{first}{s}" for s in sets),
        *(F.when(F.col(w) == F.col(first), F.col(f"{first}{s}")).otherwise(scale(w, s)).alias(f"{w}{s}") for w in others for s in sets),
        *((-F.ln(_bits(F.col(f"h{i}"), 0, 32) * _bits(F.col(f"h{i}"), 32, 32))).alias(f"c{i}") for i in range(group)),
    )
    return ready.groupBy(*keys, "g").agg(*(F.min(F.col(f"{w}{i // share}") * F.col(f"c{i}")).alias(f"a_{j}_{i}") for j, w in enumerate(weights) for i in range(group)))


def _code(rank: str) -> Column:
    """Eight hexadecimal digits of a sample, zeros for none."""
    return F.when(F.col(rank).isNull(), F.lit("0" * 8)).otherwise(F.lower(F.lpad(F.hex(F.xxhash64(rank).bitwiseAND(0xFFFFFFFF)), 8, "0")))


def _alike(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints (strings of 8 digits a sample)."""
    at = [F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8) for i in range(samples)]
    return reduce(lambda x, y: x + y, (p.cast("int") for p in at)) / F.lit(float(samples))


def _constant(values, kind: str) -> Column:
    """An array of numbers as one literal of the plan; None is null."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _section(starts: list[int], k: Column) -> Column:
    """The number (from 1) of the last start that is at most k, by halving; 0 if there is none, and for null keys."""
    array, steps = _constant(starts, "bigint"), max(1, len(starts).bit_length())
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi"))

    def halve(s, _):
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.try_element_at(array, mid) <= k)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid - 1).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), whole, halve, lambda s: s["lo"])
    return F.when(k.isNull(), F.lit(0)).otherwise(found)


def sections(own: DataFrame, size: int) -> list[int]:
    """Where sections of the keys begin, ascending: quantiles of a sample; keys that are several get a section."""
    n = own.count()
    wanted = min(BOUNDS, -(-n // size))
    share = min(1.0, SAMPLED * wanted / max(1, n))
    keys = own.select("k").where("k is not null")
    keys = sorted(r["k"] for r in (keys if share == 1 else keys.sample(share, 7)).collect())  # about SAMPLED * BOUNDS at most
    cuts = [keys[i * len(keys) // wanted] for i in range(wanted)] if keys else []
    starts = {-(1 << 63), *cuts}
    starts |= {a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < (1 << 63) - 1}
    return sorted(starts)


def in_ranges(df: DataFrame, key: str, text: str, size: int = RANGE) -> DataFrame:
    """Rows (bucket, extra, k, h, t): all documents, and as extra rows at each range's end the next range's first."""
    own = df.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"))
    starts = sections(own, size)
    placed = own.withColumn("s", _section(starts, F.col("k")))
    known = placed.groupBy("s").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).collect()  # at most 2 * BOUNDS + 2 rows
    facts = {r["s"]: r for r in known}
    width = len(starts) + 1
    of = lambda value, kind: F.try_element_at(_constant([value(facts[i]) if i in facts else None for i in range(width)], kind), F.col("s") + 1)
    parts = lambda r: max(-(-r["n"] // size), -(-r["c"] // CHARS), 1)
    lo, hi, m = of(lambda r: r["lo"], "bigint").cast("double"), of(lambda r: r["hi"], "bigint").cast("double"), of(parts, "bigint")
    by_key = F.floor((hi - F.col("k").cast("double")) / (hi - lo + 1) * m)
    by_hash = F.floor((F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * m)
    sub = F.least(F.when(hi > lo, by_key).otherwise(by_hash), m - 1)
    ordered = placed.withColumn("h", F.xxhash64("t")).withColumn("sub", sub.cast("long"))
    # Buckets are numbered as the order runs: sections from the greatest keys down, the null keys' last.
    bases, total = [0] * width, 0
    for i in [*range(width - 1, 0, -1), 0]:
        bases[i] = total
        total += parts(facts[i]) if i in facts else 0
    docs = ordered.select((F.element_at(_constant(bases, "bigint"), F.col("s") + 1) + F.col("sub")).alias("bucket"), "s", "k", "h", "t")
    first = docs.groupBy("s", "bucket").agg(F.max(F.struct("k", F.bitwise_not("h").alias("x"))).alias("f"))
    first = materialise(first.select("s", "bucket", "f.k", F.bitwise_not("f.x").alias("h")), "fingerprint-ranges")
    # The range before a section's first one is the last of the section before it (of the first section: the very last).
    ends = {r["s"]: r["e"] for r in first.groupBy("s").agg(F.max("bucket").alias("e")).collect()}
    along = [i for i in [*range(width - 1, 0, -1), 0] if i in ends]
    last = {i: ends[along[j - 1]] for j, i in enumerate(along)}
    inside = F.lag("bucket").over(W.partitionBy("s").orderBy("bucket"))
    before = F.coalesce(inside, F.try_element_at(_constant([last.get(i) for i in range(width)], "bigint"), F.col("s") + 1))
    heads = materialise(first.select(before.alias("before"), "bucket", "k", "h", F.xxhash64("bucket", "k", "h").alias("id")), "fingerprint-heads")
    near = maybe_in(docs.withColumn("id", F.xxhash64("bucket", "k", "h")), "id", id_filter(heads, "id")).where("_hit")
    d, x = near.select("bucket", "k", "h", "t", "id").alias("d"), small(heads).alias("x")
    again = d.join(x, (F.col("d.id") == F.col("x.id")) & (F.col("d.bucket") == F.col("x.bucket")) & F.col("d.k").eqNullSafe(F.col("x.k")) & (F.col("d.h") == F.col("x.h")))
    again = again.select(F.col("before").alias("bucket"), F.lit(1).alias("extra"), "d.k", "d.h", "d.t").dropDuplicates(["bucket"])
    return docs.select("bucket", F.lit(0).alias("extra"), "k", "h", "t").unionByName(again)


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's.
    """
    order = W.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("k"), "h")
    n, half = F.length("t"), F.expr("length(t) div 2")
    seen = in_ranges(df, key, text).select("bucket", "extra", "k", "t", F.row_number().over(order).alias("row"), F.lead("t", 1, "").over(order).alias("u"))
    edited = F.when(F.col("extra") == 1, F.lit("")).otherwise(F.concat(F.substring("t", F.lit(1), n - half), F.substring("u", F.lit(1), half)))
    seen = seen.select("bucket", "row", "extra", "k", "t", edited.alias("e"))
    # What is known of a document goes along as one more word, told by its leading space, so that texts move once.
    facts = F.concat_ws(" ", F.lit(""), F.col("extra").cast("string"), n.cast("string"), F.sha2("e", 256), F.col("k").cast("string"))
    words = seen.select("bucket", "row", F.split("t", SPACE).alias("a"), F.split("e", SPACE).alias("b"), F.array(facts).alias("c"))
    words = words.select("bucket", "row", F.size("a").alias("n"), F.posexplode(F.concat("a", "b", "c")).alias("at", "word"))
    fact = F.substring("word", 1, 1) == " "
    terms = words.select(
        "bucket", "row", F.when(~fact & (F.col("word") != ""), F.xxhash64("word")).alias("term"), F.when(fact, F.col("word")).alias("fact"),
        (F.col("at") < F.col("n")).cast("int").alias("own"),
    )
    terms = terms.groupBy("bucket", "row", "term", "fact").agg(F.sum("own").alias("w"), F.count("*").alias("all"))
    known = F.col("term").isNotNull()
    terms = terms.select("bucket", "row", "fact", "term", F.when(known, F.col("w")).alias("w"), F.when(known, F.col("all") - F.col("w")).alias("v"))
    least = ranks(terms, ["bucket", "row", "fact"], ["w", "v"])
    coded = least.select("bucket", "row", "fact", "g", *(F.concat(*(_code(f"a_{j}_{i}") for i in range(GROUP))).alias(c) for j, c in enumerate(("f", "e"))))
    marks = coded.groupBy("bucket", "row").agg(
        F.max("fact").alias("fact"), F.sort_array(F.collect_list(F.when(F.col("fact").isNull(), F.struct("g", "f", "e")))).alias("s")
    )
    part = F.split("fact", " ", -1)
    none = F.lit("0" * 8 * SAMPLES)
    out = marks.select(
        "bucket", "row", part[1].cast("int").alias("extra"), part[2].cast("long").alias("n_chars"), part[3].alias("edited_sha256"),
        F.when(F.size(part) > 4, part[4].cast("long")).alias("k"),
        F.when(F.size("s") > 0, F.array_join("s.f", "")).otherwise(none).alias("fingerprint"), F.when(F.size("s") > 0, F.array_join("s.e", "")).otherwise(none).alias("edited_fingerprint"),
    )
    out = out.withColumn("_next", F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("row"))).where("extra = 0")
    return out.select(
        F.col("k").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _alike(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), _alike(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
