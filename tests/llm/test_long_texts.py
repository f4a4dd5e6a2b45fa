"""Every operator and stage on texts of a million characters and more."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwave.llm import decontaminate, pii, quality_model, quality_rules, secrets, toxicity
from gridwave.llm.jaccard import ngram_jaccard_join
from gridwave.llm.packing import best_fit_packing
from gridwave.llm.queries import grade, token_test, vocabulary
from gridwave.llm.sharding import kd_shards
from gridwave.llm.token_counts import token_counts

from .fixtures import frame

N = 1_000_000
TEXTS = [" " * 2 * N + "x", "\t" * N, "a" * N, "!" * N, "a b " * (N // 4), "12 " * (N // 3), "\n".join(["some line of words"] * (N // 20)), None, "short one"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    frame(spark, list(enumerate(TEXTS))).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b a b a b a b a b a b"), (2, "no such words at all here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


OPERATORS = {
    "kd_shards": lambda s, d, f: kd_shards(d, shards=2),
    "jaccard": lambda s, d, f: ngram_jaccard_join(d),
    "quality": lambda s, d, f: quality_model.quality_scores(d, quality_model.fit(d, s.read.parquet(f"{f}/labels.parquet"), grade())),
    "overlap": lambda s, d, f: decontaminate.benchmark_overlap(d, s.read.parquet(f"{f}/benchmark.parquet")),
    "token_counts": lambda s, d, f: token_counts(d, vocabulary("byte_bpe_50k.tiktoken")),
    "secrets": lambda s, d, f: secrets.secret_scan(d, token_test()),
    "pii": lambda s, d, f: pii.pii_scan(d),
    "rules": lambda s, d, f: quality_rules.quality_rules(d),
    "toxicity": lambda s, d, f: toxicity.toxicity_scores(d, toxicity.fit(d, s.read.parquet(f"{f}/labels.parquet"), F.col("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = OPERATORS[name](spark, docs, tables)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(len(TEXTS)))


def test_overlap_of_a_long_text(spark, tables):
    got = {r.doc_id: r for r in OPERATORS["overlap"](spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).collect()}
    assert (got[4].n_words, got[4].n_hit, got[4].longest_match) == (N // 2, N // 2, 12) and got[0].n_hit == 0


def test_packing(spark, tables):
    got = best_fit_packing(spark.read.parquet(f"{tables}/documents.parquet"), vocabulary("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in got} == set(range(len(TEXTS))) and sum(r.length for r in got if r.doc_id == 0) == 2 * N + 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, tables).count() > 0
