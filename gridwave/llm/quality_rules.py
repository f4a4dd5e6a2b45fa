"""Rules on whole texts: length, repetition, symbols, and zstandard compression bands.

A text that compresses far better than prose of its length repeats itself; one that
hardly compresses is random or encoded. Both the whole text and chunks of several sizes
are held against limits for their length, since prose compresses better the longer it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks, utf8
from .words import SPACED, Words, windows

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio bytes / compressed bytes, by bytes of text.

    limits: (from so many bytes, least ratio, largest ratio), ascending; shorter texts
    than the first have no limits. The least ratios lie between those of random words of
    letters and digits and those of prose, at every length of their band. Chunks that fall
    outside are allowed up to a share of the bytes; chunk is the largest size of them, and
    small_chunks has limits for the other sizes.
    """

    limits: tuple = ((256, 1.25, 3.0), (512, 1.35, 3.5), (1024, 1.4, 4.0), (4096, 1.5, 4.5), (16384, 1.5, 6.0), (65536, 1.5, 8.0))
    level: int = 3
    chunk: int = 2048
    chunk_limits: tuple = (1.4, 4.0)
    small_chunks: tuple = ((1024, 1.4, 4.0), (512, 1.3, 3.5), (256, 1.15, 3.0))
    chunk_share: float = 0.25


def chunk_shares(text: bytes, packer, bands: Bands) -> tuple[float, float, float]:
    """Shares of the bytes in chunks under the band, over it, and outside: the largest of any chunk size.

    Small sizes give short texts chunks, and show parts that a large chunk hides. Chunks
    cover the whole text: the last one ends with it and counts for the bytes that no
    earlier one holds.
    """
    n, most = len(text), (0.0, 0.0, 0.0)
    for size, low, high in ((bands.chunk, *bands.chunk_limits), *bands.small_chunks):
        under = over = 0
        for at in range(0, n, size) if n >= size else ():
            start = min(at, n - size)
            ratio = size / len(packer.compress(text[start : start + size]))
            under += (ratio < low) * (start + size - at)
            over += (ratio > high) * (start + size - at)
        most = tuple(max(x, y / n) for x, y in zip(most, (under, over, under + over)))
    return most


def compression(text: bytes, packer, bands: Bands) -> tuple[float, float, str | None]:
    """Whole ratio, share of bytes in chunks outside the band, and a verdict: null, repetitive or incompressible."""
    if not text:
        return 0.0, 0.0, None
    whole = len(text) / len(packer.compress(text))
    low = high = None
    for least, a, b in bands.limits:
        if len(text) >= least:
            low, high = a, b
    under, over, outside = chunk_shares(text, packer, bands)
    verdict = None
    if low is not None:
        if whole > high or over > bands.chunk_share:
            verdict = "repetitive"
        elif whole < low or under > bands.chunk_share:
            verdict = "incompressible"
    return whole, outside, verdict


def repeated_words(words: Words, size: int = 8) -> np.ndarray:
    """Per text, the words inside windows that occur in it twice or more."""
    h, owner = windows(words.hash, size), words.text_of_word()
    n = len(h)
    if n == 0:
        return np.zeros(words.n_texts, np.int64)
    inside = np.flatnonzero(owner[:n] == owner[size - 1 : size - 1 + n])
    order = inside[np.lexsort((h[inside], owner[inside]))]
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.bincount(owner, weights=np.cumsum(change[:-1]) > 0, minlength=words.n_texts).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def judge(texts: list, bands: Bands) -> dict:
    """All measures of a chunk of texts, as columns."""
    raw = utf8(texts)
    w = Words(raw, SPACED)
    packer = zstandard.ZstdCompressor(level=bands.level)
    points = (w.buf & 0xC0) != 0x80
    n_words, repeat = w.counts, repeated_words(w)
    failed = (n_words < 20) | (100 * repeat > 30 * n_words)
    pressed = [compression(t, packer, bands) for t in raw]
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "word_chars": pa.array(w.sums(points & w.is_word), pa.int64()),
        "n_symbols": pa.array(w.sums(_SYMBOL[w.buf]), pa.int64()),
        "n_dup_lines": pa.array([duplicate_lines(t) for t in raw], pa.int64()),
        "n_repeat_words": pa.array(repeat, pa.int64()),
        "base_failed": pa.array(failed),
        "kept": pa.array([not f and p[2] is None for f, p in zip(failed, pressed)], pa.bool_()),
        "zstd_ratio": pa.array([p[0] for p in pressed], pa.float64()),
        "chunks_out": pa.array([p[1] for p in pressed], pa.float64()),
        "band_verdict": pa.array([p[2] for p in pressed], pa.string()),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunks_out double, band_verdict string"


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """A row of measures and a verdict per document, in one pass without a shuffle.

    Words are runs of anything but ASCII white space. base_failed: fewer than 20 words, or
    over 30 % of them in 8-word windows that the text repeats. kept: not base_failed, and
    the compression bands hold; a ratio just at a limit holds, and of lines that are alike the
    first is no duplicate. A null text counts as empty (no words, base_failed). A text of any
    length is read whole, in memory in proportion to it. Null or repeated ids give a row each; empty input gives no rows; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | judge(texts, bands))

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
