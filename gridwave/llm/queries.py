"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables.

Each runs its operator with production parameters and derives the digest columns that
results are compared by from the operator's real output.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, pii, quality_model, quality_rules, secrets, toxicity
from .jaccard import ngram_jaccard_join
from .packing import best_fit_packing
from .sharding import kd_shards
from .token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer's file: in a given folder, or where the environment keeps them."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_test(folder: str | None = None) -> secrets.TokenTest:
    from .bpe import PATTERN

    return secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken", folder), PATTERN)


def grade() -> Column:
    """Ratings from the labels: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal bytes: cells of a K-d tree over n_chars, lang and source."""
    out = kd_shards(_table(spark, sf_dir, "documents"), shards=8)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at Jaccard 0.8 over five-word shingles; the least id of each component."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), "doc_id", "text", words=5, percent=80)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; every document ends with id 0."""
    return best_fit_packing(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2048, 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, and selection by the probability of grade 1 or better."""
    docs = _table(spark, sf_dir, "documents")
    return quality_model.quality_scores(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels"), grade()))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    found = decontaminate.benchmark_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match piece counts under the byte vocabulary."""
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of known forms, and strings with few characters a token; of the token test also how much it looked at, and what it holds for random."""
    found = secrets.secret_scan(_table(spark, sf_dir, "documents"), token_test())
    random = F.filter("tested", lambda t: t["verdict"] == "random")
    return found.select(
        "doc_id", *(_count("base", k) for k in ("assign", "access", "hex")), _sha(_joined("base")).alias("base_sha256"), _joined("spans").alias("spans"),
        F.size("tested").cast("long").alias("n_tested"), F.array_join(F.transform(random, lambda t: F.concat_ws(":", t["start"].cast("string"), t["end"].cast("string"))), ",").alias("random"), F.array_min(F.transform("tested", lambda t: t["ratio"])).alias("least_ratio"),
    )


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of stated forms, and what the boosted trees add; of the trees also how many candidates they scored and selected.

    The trees learn in documents outside the held-out fifth.
    """
    docs = _table(spark, sf_dir, "documents")
    found = pii.pii_scan(docs, selector=pii.fit(docs.where(~F.coalesce(_held_out(), F.lit(False)))))
    return found.select(
        "doc_id", *(_count("base", k) for k in pii.BASE_KINDS), _sha(_joined("base")).alias("base_sha256"), _joined("spans").alias("spans"),
        F.size("candidates").cast("long").alias("n_scored"), F.size(F.filter("candidates", lambda c: c["selected"])).cast("long").alias("n_selected"), F.array_max(F.transform("candidates", lambda c: c["score"])).alias("best_score"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rules and compression bands."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from weak supervision; the toxic rate comes from rows outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = _held_out()
    model = toxicity.fit(docs, labels.where(~held_out), F.col("toxic"))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_sharding, op2_ngram_jaccard_join, op3_best_fit_packing, op4_quality_classifier, op5_benchmark_decontamination,
        op6_token_counts, op7_secret_scan, op8_pii, op9_quality_rules, op10_toxicity,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op5_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)
), m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
