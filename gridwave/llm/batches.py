"""Arrow batches of texts, cut into chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

from .words import pieces_of

#: Bytes of text that one vectorised step works on; a longer text is a chunk of its own.
#: A step takes up to about 100 bytes of memory a byte of its chunk.
CHUNK_BYTES = 1 << 20

#: Rows of an Arrow batch, and the session's setting for it with its default.
BATCH_ROWS, _SETTING, _DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in batches that stay small where each row is a text.

    A batch stands in the JVM and in Python at once, and the default of 10,000 texts can be
    a gigabyte. A session that has its own setting keeps it; otherwise it becomes BATCH_ROWS.
    """
    conf = df.sparkSession.conf
    if conf.get(_SETTING) == _DEFAULT:
        conf.set(_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text; None where it is null."""
    return column.cast(pa.large_binary()).to_pylist()


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batches, put together or cut to about so many bytes of text; only the texts of one part are held as Python bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
        if size >= limit:
            yield from _cut(held, text, limit)
            held, size = [], 0
    yield from _cut(held, text, limit)


def _cut(held: list, text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
        at = batch.schema.get_field_index(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        for a, b in pieces_of(sizes, sizes.tolist(), limit):
            part = batch.slice(a, b - a)
            yield part, as_bytes(part.column(at))


def utf8(texts: list) -> list[bytes]:
    return [t or b"" for t in texts]


def with_columns(batch: pa.RecordBatch, names: list[str], added: dict) -> pa.RecordBatch:
    """Some columns of the batch followed by new ones."""
    kept = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    return pa.RecordBatch.from_pydict(kept | added)
