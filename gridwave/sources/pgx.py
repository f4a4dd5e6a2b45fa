"""PGX and binary PGM images as rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "path string, width int, height int, bit_depth int, signed boolean, samples array<int>, error string"
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.string())
_PGX = re.compile(rb"PG[ \t]+(ML|LM)[ \t]+([+-]?)[ \t]*([0-9]+)[ \t]+([0-9]+)[ \t]+([0-9]+)[ \t]*\r?\n")


def parse_pgx(data: bytes) -> tuple[int, int, int, bool, np.ndarray]:
    """Width, height, depth, signed, samples. A sign may stand apart from the depth or right before it."""
    m = _PGX.match(data)
    if not m:
        raise ValueError("no PGX header")
    depth, w, h = (int(x) for x in m.groups()[2:])
    if not 1 <= depth <= 32 or not w or not h:
        raise ValueError("PGX geometry")
    size = -(-depth // 8)
    body = data[m.end() :]
    if len(body) != w * h * size:
        raise ValueError("PGX body length")
    raw = np.frombuffer(body, np.uint8).reshape(-1, size).astype(np.int64)
    order = range(size) if m[1] == b"ML" else reversed(range(size))
    v = np.zeros(w * h, np.int64)
    for k in order:
        v = v << 8 | raw[:, k]
    v &= (1 << depth) - 1
    signed = m[2] == b"-"
    if signed:
        v = np.where(v >> depth - 1, v - (1 << depth), v)
    return w, h, depth, signed, v


def parse_pgm(data: bytes) -> tuple[int, int, int, bool, np.ndarray]:
    """An 8-bit grey P5 image; comments run from # to the line's end."""
    fields, at = [], 2
    if data[:2] != b"P5":
        raise ValueError("no P5 header")
    while len(fields) < 3:
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*([0-9]+)").match(data, at)
        if not m:
            raise ValueError("PGM header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields
    body = data[at + 1 :]
    if top != 255 or len(body) != w * h:
        raise ValueError("PGM body")
    return w, h, 8, False, np.frombuffer(body, np.uint8).astype(np.int64)


def to_pgm(images: DataFrame) -> DataFrame:
    """images with `content`, a binary P5 file, built without Python; null unless 8 bits, unsigned and whole."""
    fits = (F.col("bit_depth") == 8) & ~F.col("signed") & (F.size("samples") == F.col("width") * F.col("height")) & F.forall("samples", lambda v: v.between(0, 255))
    head = F.encode(F.format_string("P5\n%d %d\n255\n", F.col("width"), F.col("height")), "UTF-8")
    body = F.unhex(F.array_join(F.transform("samples", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    return images.withColumn("content", F.when(fits, F.concat(head, body)))


def write_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def _images(files: DataFrame, parse, content: str, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    w, h, depth, signed, v = parse(data or b"")
                    rows.append((name, w, h, depth, signed, np.where(v >= 1 << 31, v - (1 << 32), v).astype(np.int32), None))
                except ValueError as e:
                    rows.append((name, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, _KINDS)], names=[x.split()[0] for x in IMAGE.split(", ")])

    return files.select(path, content).mapInArrow(run, IMAGE)


def pgx_images(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """An image per PGX file in a binary column, or its error. Unsigned 32-bit values wrap."""
    return _images(files, parse_pgx, content, path)


def pgm_images(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    return _images(files, parse_pgm, content, path)
