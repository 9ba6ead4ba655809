"""The corpus operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, mixing, packing, quality, simhash, subdedup, tokencount, urlfilter, warc
from .bpe import public_path

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_path(VOCABULARY))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subdedup.classes(subdedup.dedup(table(spark, sf_dir, "documents")))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.scores(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path(VOCABULARY))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


#: The mixture's tree and target weights (others count 1); the domain is the source's number modulo 3.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"domain0": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}}


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.concat(F.lit("domain"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as int) % 3"), F.lit(0)).cast("string")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    out = mixing.mix(docs, LEVELS, WEIGHTS)
    return out.select("doc_id", "domain", "lang", "source", mixing.token_count().alias("n_tokens"), "epoch")


#: The rules that op10 is to judge by.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urlfilter.RULES)
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY x) AS one, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> one THEN one END AS refers_to FROM d
"""

OP10_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def _fill_sql(name: str, parents: list[str], level: str, weight: str, above: str) -> str:
    """Common table `name`: nodes of one level with their share of the parents' budgets (see mixing._fill)."""
    by = f"PARTITION BY {', '.join(parents)} " if parents else ""
    keys = ", ".join([*parents, level])
    return f"""
{name}_n AS (SELECT {keys}, sum(tokens) * 4 AS cap, {weight} AS w FROM leaves GROUP BY {keys}),
{name}_a AS (SELECT n.*, p.above FROM {name}_n n {above}),
{name}_l AS (
  SELECT *, cap / w AS ratio,
         (above - coalesce(sum(cap) OVER ({by}ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by}ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM {name}_a),
{name}_o AS (SELECT *, min(CASE WHEN ratio > lev THEN struct_pack(r := ratio, k := {level}, v := lev) END) OVER ({by}) AS o FROM {name}_l),
{name} AS (SELECT {keys}, CASE WHEN ratio <= lev THEN CAST(cap AS DOUBLE) ELSE o.v * w END AS above FROM {name}_o)"""


def _case(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1.0 END" if level in WEIGHTS else "1.0"


OP9_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, 'domain' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 3, 0) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS DOUBLE) AS above FROM leaves),"""
    + _fill_sql("f1", [], "domain", _case("domain"), "CROSS JOIN root p")
    + ","
    + _fill_sql("f2", ["domain"], "lang", _case("lang"), "JOIN f1 p ON p.domain = n.domain")
    + ","
    + _fill_sql("f3", ["domain", "lang"], "source", _case("source"), "JOIN f2 p ON p.domain = n.domain AND p.lang = n.lang")
    + """,
b AS (SELECT l.*, CAST(floor(f3.above + 1e-6) AS BIGINT) AS budget FROM leaves l JOIN f3 USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM b),
x AS (SELECT d.*, e.whole, e.budget - e.whole * e.tokens AS rest FROM d JOIN e USING (domain, lang, source)),
o AS (SELECT *, substr(md5('7|' || whole || '|' || doc_id), 1, 15) AS ord FROM x),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY ord, doc_id RANGE UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(CAST(whole AS BIGINT))) AS epoch FROM r
UNION ALL
SELECT doc_id, domain, lang, source, n, CAST(whole AS BIGINT) FROM r WHERE rest > 0 AND upto <= rest"""
)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_token_counts, op2_substring_dedup, op3_document_fingerprints, op4_simhash_near_dedup, op5_quality_classifier, op6_packing, op7_warc, op8_nearest_neighbours, op9_mixing, op10_url_filters,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op9_mixing": OP9_SQL, "op10_url_filters": OP10_SQL}
