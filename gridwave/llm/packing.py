"""Best-fit packing of documents into token sequences, planned on a length histogram.

1. A scan tokenizes the texts and cuts those over the sequence length into full pieces
   and a shorter first one.
2. The driver packs counts: for each length from the longest on, pieces go to the
   sequences with the least room that holds them. Sequences with one history form a
   run of consecutive numbers, so the plan has a few rows per length (the lengths are
   bounded by the sequence length, never by the documents).
3. Pieces take planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks
from .bpe import encoder
from .ranks import with_rank
from .store import Scratch


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) of a best-fit-decreasing packing.

    Piece number first rank + i of that length goes to sequence first sequence + i.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # distinct free rooms, ascending
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    sequences = 0

    def put(room, first, count):
        if not runs[room]:
            insort(rooms, room)
        runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = runs[room].pop()
                if not runs[room]:
                    rooms.pop(i)
                if count > left:
                    put(room, first + left, count - left)
                    count = left
            else:  # new sequences, as many as could be filled with this length alone
                each = capacity // length
                room, first, count = capacity, sequences, max(1, left // each)
                sequences += count
            rows.append((length, rank, count, first, capacity - room))
            rank, left = rank + count, left - count
            put(room - length, first, count)
    return rows


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)] if n else []
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(df: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids, end_id, cut to the capacity; a null text counts as empty."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, {PIECES}"

    def run(batches):
        enc = encoder(vocabulary)
        for batch, texts in text_chunks(batches, "text"):
            owner, rows, parts = [], [], []
            for i, t in enumerate(texts):
                ids = np.append(enc.ids((t or b"").decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    owner.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                    parts.append(ids[s : s + n])
            piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
            listed = pa.array([p.tobytes() for p in parts] if with_ids else [None] * len(parts), pa.binary())
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc), "ids": listed,
            })

    return map_texts(docs, run, schema)


def best_fit_packing(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) per piece; if asked for, ids too:
    little-endian unsigned 32-bit numbers in a row, as numpy.frombuffer(ids, "<u4") reads them.

    Every document ends with end_id, so a null or empty text is one piece of one id. Null
    or repeated ids are packed like others, each row on its own, ties in length in the
    order of id, piece and CRC. A text of any length is read whole, in memory in
    proportion to it. Empty input gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    store = Scratch(spark, "packing")
    pieces = token_pieces(df, vocabulary, capacity, end_id, id_col, text_col, with_ids)
    if not with_ids:
        pieces = pieces.drop("ids")
    # one plain number a row, so that rows alike in everything can still be dealt apart
    pieces = store.table(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    ranked = with_rank(pieces, sum(counts.values()), "length", ["id", "piece", "ids_crc32", "_row"], F.col("_row"), "_rank")
    # a few rows a length, whatever the documents
    slots = spark.createDataFrame(plan(counts, capacity), "length long, _first long, _count long, _sequence long, offset long")
    placed = ranked.join(F.broadcast(slots), "length").where("_rank >= _first AND _rank < _first + _count")
    kept = [F.col(c) for c in pieces.columns if c not in ("id", "_row")]
    return placed.select(F.col("id").alias(id_col), *kept, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")
