"""Ordinal quality classifier over hashed text.

Grades are ordered ratings. One weight per hashed feature and ordered thresholds give
the expected grade and the probability of a grade or better, by which documents are
selected. Features are means over the text, so length alone decides nothing: hashed
words, shapes of three bytes (case, digits, marks), and words that repeat a recent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks, utf8, with_columns
from .linear import CumulativeLink, Rows
from .sampling import by_hash, share_of
from .words import FOLD, SPACED, Words

WORD_BITS, SHAPE_BITS = 17, 13
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 3
_REPEATS = SIZE - 3
_WEIGHT = {"word": 3.0, "shape": 4.0, "repeat": 2.0}

_b = np.arange(256)
_SHAPE = np.where((_b >= 97) & (_b <= 122) | (_b >= 128), 97, np.where((_b >= 65) & (_b <= 90), 65, np.where((_b >= 48) & (_b <= 57), 48, np.where(_b <= 32, 32, _b)))).astype(np.uint32)


class Features:
    """Hashed feature numbers of each word and byte of some texts, with their weight in the text."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, SPACED, FOLD)
        self.n = w.n_texts
        n_words = np.maximum(w.counts, 1)
        owner = w.text_of_word()
        word = (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        parts = [(owner, word, _WEIGHT["word"] / n_words[owner])]
        s = _SHAPE[w.buf]
        text = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(w.offset))[: max(len(s) - 2, 0)]
        shape = ((s[:-2] * np.uint32(131) + s[1:-1]) * np.uint32(137) + s[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - SHAPE_BITS)
        inside = np.ones(len(text), bool)  # three bytes of one text
        for back in (1, 2, 3):
            at = w.offset[1:] - back
            inside[at[(at >= 0) & (at < len(text))]] = False
        text, shape = text[inside], shape[inside].astype(np.int32)
        n_shapes = np.maximum(np.bincount(text, minlength=self.n), 1)
        parts.append((text, shape + np.int32(1 << WORD_BITS), (_WEIGHT["shape"] / n_shapes).astype(np.float32)[text]))
        for k, back in enumerate((1, 2)):
            same = np.flatnonzero((w.hash[back:] == w.hash[:-back]) & (owner[back:] == owner[:-back])) + back
            parts.append((owner[same], np.full(len(same), _REPEATS + k), _WEIGHT["repeat"] / n_words[owner[same]]))
        self.parts = parts

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return sum(np.bincount(o, weights=weights[i] * v, minlength=self.n) for o, i, v in self.parts)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct features and their values."""
        owner, index, value = (np.concatenate(x) for x in zip(*self.parts))
        key = owner * SIZE + index
        distinct, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, weights=value, minlength=len(distinct))
        cut = np.searchsorted(distinct, np.arange(1, self.n) * SIZE)
        yield from zip(np.split(distinct % SIZE, cut), np.split(total.astype(np.float32), cut))


#: Texts whose distinct features are listed at once; a byte of text takes a hundred or so here.
_FIT_BYTES = 128 << 10


def fit(df: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 8000) -> CumulativeLink:
    """The model from `sample` rated documents at most, those with the smallest hashes of the id.

    grade: an integer column over ratings, from 0; rows where it is null are left out, and of
    ratings of one id the highest counts, of documents of one id one. The sample's features
    come to the driver, a few kB each. Null and empty texts have no features. Without
    ratings, or documents that have them, every text scores 0.
    """
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").alias("grade"))
    rated = rated.where(by_hash(share_of(sample, rated.count()), "id"))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rated), "id").select("id", "text", "grade")  # about `sample` rows

    def run(batches):
        for batch, texts in text_chunks(batches, "text", _FIT_BYTES):
            got = list(Features(utf8(texts)).rows())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "grade": batch.column(2), "index": pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), "value": pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())})

    found = map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, grade int, index binary, value binary")
    found = found.groupBy("id").agg(F.min(F.struct("index", "value", "grade")).alias("row")).select(F.xxhash64("id").alias("h"), "row.*")
    rows = sorted(found.toArrow().to_pylist(), key=lambda r: (r["h"] & (2**64 - 1), r["index"]))[:sample]
    if not rows:
        return CumulativeLink(np.zeros(SIZE), np.zeros(1))
    rows.sort(key=lambda r: (r["grade"], r["index"], r["value"]))  # the fit doesn't depend on the order of tasks
    y = np.array([r["grade"] for r in rows])
    target = np.eye(max(2, int(y.max()) + 1))[y]
    return CumulativeLink.fit(Rows.of([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in rows]), target, SIZE)


def _judged(model: CumulativeLink, texts: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    tails = model.tails(Features(utf8(texts)).scores(model.weights))
    return tails.sum(axis=1), tails[:, min(least, tails.shape[1]) - 1]


def quality_scores(df: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", least: int = 1, threshold: float = 0.5) -> DataFrame:
    """(id_col, expected_grade, p_selected, selected) per document.

    p_selected: the probability of grade `least` or better; selected where it reaches the
    threshold, ties included. A null or empty text has no features and gets the model's base
    rates; a text of any length is read whole, in memory in proportion to it. Null or
    repeated ids give a row each; empty input gives no rows; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            grade, p = _judged(shared.value, texts, least)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "expected_grade": pa.array(grade), "p_selected": pa.array(p), "selected": pa.array(p >= threshold)})

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, expected_grade double, p_selected double, selected boolean").withColumnRenamed("id", id_col)


def select_quality(df: DataFrame, model: CumulativeLink, text_col: str = "text", least: int = 1, threshold: float = 0.5) -> DataFrame:
    """The selected documents, all columns as they were.

    Null, empty and repeated rows as in quality_scores; an empty table stays empty.
    """
    shared, names = df.sparkSession.sparkContext.broadcast(model), df.columns

    def run(batches):
        for batch, texts in text_chunks(batches, text_col):
            yield with_columns(batch, names, {}).filter(pa.array(_judged(shared.value, texts, least)[1] >= threshold))

    return map_texts(df, run, df.schema)
