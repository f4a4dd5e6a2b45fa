"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. Stages that drop documents keep every other row as it was.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.llm import decontaminate, quality_model, secrets
from gridwave.llm.batches import map_texts, text_chunks
from gridwave.llm.jaccard import ngram_jaccard_join
from gridwave.llm.packing import best_fit_packing
from gridwave.llm.queries import grade, token_test, vocabulary
from gridwave.llm.store import Scratch, released


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or better reaches one half.

    Rows without an id or without ratings are judged like others; a null or empty text has
    the model's base rates; without any ratings all documents stay.
    """
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade())
    return quality_model.select_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity component, the one with the least id.

    Rows are told apart by id and text: of rows that share an id each stays or goes by its
    own text, rows alike in both stay or go together, and a row without an id stays only
    where no row with one is like it. Null and wordless texts are like nothing and stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("text_key"))
    found = ngram_jaccard_join(docs.select(key.alias("key"), "text"), "key", "text", words=5, percent=80)
    gone = found.where(~F.col("key").eqNullSafe(F.col("component_id"))).select("key.own_id", "key.text_key").distinct()
    same = docs["doc_id"].eqNullSafe(gone["own_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item; null and wordless texts stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows where a text changes. Null texts stay null."""
    test, names = token_test(), docs.columns

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            found = [secrets.scan(t, test)[1] if t else [] for t in texts]
            if any(found):
                new = [secrets.redact(t.decode("utf-8", "replace"), s) if s else None for t, s in zip(texts, found)]
                changed = pa.array([bool(s) for s in found])
                cols["text"] = pa.compute.if_else(changed, pa.array(new, cols["text"].type), cols["text"])
                if "n_chars" in cols:
                    cols["n_chars"] = pa.compute.if_else(changed, pa.array([len(t) if t is not None else None for t in new], cols["n_chars"].type), cols["n_chars"])
            yield pa.RecordBatch.from_pydict(cols)

    return map_texts(docs, run, docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, token ids included, in sequences of 2048 tokens; a null or empty text is one end id."""
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), 2048, 0, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("packing", packing),
]

#: SQL can't express the stages; they are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage leaves behind goes when the next one is written."""
    store, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with released():
            docs = store.table(stage(spark, docs, sf_dir), name)
        if last:
            store.drop(last)
        last = name
    return docs
