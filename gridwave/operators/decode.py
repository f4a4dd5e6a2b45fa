"""Decoding as a DataFrame transformation.

Faults are values: a bad row has a null image and a struct of kind and message, and never
ends the job. mode "FAILFAST" raises on it, "DROPMALFORMED" drops it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import grid, headers
from ..codec.faults import Fault
from ..functions import geometry_fault, siz_fields
from ..plans.strategy import choose

MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")
_FAULT = pa.struct([("kind", pa.string()), ("message", pa.string())])
FAULT = "struct<kind:string,message:string>"
IMAGE = f"width int, height int, bit_depth int, signed boolean, samples array<int>, error {FAULT}"
HEADER = (
    "struct<siz:struct<x_size:bigint,y_size:bigint,tile_w:bigint,tile_h:bigint,bit_depth:int,signed:boolean,x_sampling:int,y_sampling:int>,"
    "cod:struct<progression:string,layers:int,levels:int,xcb:int,ycb:int,style:int,transform:string>,"
    "qcd:struct<style:string,guard_bits:int,steps:array<struct<exp:int,mant:int>>>,packet_off:bigint,packet_len:bigint>"
)


def _kept(batch: pa.RecordBatch, names: list[str]) -> dict:
    return {n: batch.column(batch.schema.get_field_index(n)) for n in names}


def _fault(e: Exception) -> dict:
    """Anything unforeseen in hostile bytes is a fault of the stream, too."""
    return {"kind": e.kind, "message": e.message} if isinstance(e, Fault) else {"kind": "Codestream", "message": f"{type(e).__name__}: {e}"}


def _columns(df: DataFrame, content: str, added: tuple) -> tuple[list[str], str]:
    names = [c for c in df.columns if c != content and c not in added]
    return names, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def with_headers(df: DataFrame, content: str = "content") -> DataFrame:
    """df with `siz` (by fixed offsets, without Python), `header` and `error`.

    Filters on siz run before any Python; header and error are one Arrow batch function
    that is dropped from the plan if neither is selected.
    """

    @F.pandas_udf(f"struct<header:{HEADER},error:{FAULT}>")
    def parsed(data):
        import pandas as pd

        heads, faults = [], []
        for x in data:
            try:
                if x is None:
                    raise Fault("Codestream", "no bytes")
                h = headers.parse(bytes(x))
                q = h.qcd | {"steps": [{"exp": e, "mant": m} for e, m in h.qcd["steps"]]}
                siz = {k: v for k, v in h.siz.items() if k not in ("x_off", "y_off", "tile_x_off", "tile_y_off")}
                heads.append({"siz": siz, "cod": h.cod, "qcd": q, "packet_off": h.packet_off, "packet_len": h.packet_len})
                faults.append(None)
            except Exception as e:
                heads.append(None)
                faults.append(_fault(e))
        return pd.DataFrame({"header": pd.Series(heads, dtype=object), "error": pd.Series(faults, dtype=object)})

    both = df.withColumn("siz", siz_fields(content)).withColumn("_parsed", parsed(F.col(content)))
    return both.withColumn("header", F.col("_parsed.header")).withColumn("error", F.col("_parsed.error")).drop("_parsed")


_BLOCKS = "band_idx int, kind string, block_idx int, x int, y int, w int, h int, num_passes int, zero_bit_planes int, planes int, segment binary, error " + FAULT


def code_blocks(df: DataFrame, content: str = "content", absent: bool = False) -> DataFrame:
    """One row per code-block with its segment, next to the other columns of df.

    Blocks without passes are left out unless asked for. A stream with a fault in its
    header or packets gives one row with the error and null block fields.
    """
    names, kept = _columns(df, content, tuple(c.split()[0] for c in _BLOCKS.split(", ")))
    kinds = [("band_idx", pa.int32()), ("kind", pa.string()), *((n, pa.int32()) for n in ("block_idx", "x", "y", "w", "h", "num_passes", "zero_bit_planes", "planes")), ("segment", pa.binary()), ("error", _FAULT)]

    def run(batches):
        for batch in batches:
            rows, owner = [], []
            for i, data in enumerate(batch.column(batch.schema.get_field_index(content)).to_pylist()):
                try:
                    if data is None:
                        raise Fault("Codestream", "no bytes")
                    head, bands, blocks = _packets(data)
                    for b in blocks:
                        if b.passes or absent:
                            planes = grid.bit_planes(head.qcd, b.band)
                            rows.append((b.band, bands[b.band].kind, b.index, b.x, b.y, b.w, b.h, b.passes, b.zero_planes, planes, data[b.offset : b.offset + b.length], None))
                            owner.append(i)
                except Exception as e:
                    rows.append((*(None,) * 11, _fault(e)))
                    owner.append(i)
            cols = list(zip(*rows)) or [()] * len(kinds)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_pydict({n: c.take(take) for n, c in _kept(batch, names).items()} | {n: pa.array(c, k) for (n, k), c in zip(kinds, cols)})

    return df.select(*names, content).mapInArrow(run, kept + _BLOCKS)


def _packets(data: bytes):
    head = headers.parse(data)
    c = head.cod
    bands = grid.band_grids(head.width, head.height, c["levels"], c["xcb"], c["ycb"])
    return head, bands, grid.read_packets(data, bands, head.packet_off, head.packet_off + head.packet_len)


def _image(head: headers.Header, samples: np.ndarray) -> tuple:
    return head.width, head.height, head.siz["bit_depth"], head.siz["signed"], samples.ravel().astype(np.int32), None


_IMAGE_KINDS = (("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("signed", pa.bool_()), ("samples", pa.list_(pa.int32())), ("error", _FAULT))


def _image_columns(rows: list[tuple]) -> dict:
    return {n: pa.array(c, k) for (n, k), c in zip(_IMAGE_KINDS, list(zip(*rows)) or [()] * len(_IMAGE_KINDS))}


def decode(df: DataFrame, content: str = "content", mode: str = "PERMISSIVE", strategy: str = "auto") -> DataFrame:
    """Images of the codestreams in a binary column, next to the other columns of df, one for each row.

    strategy "fused": one row in, one out, no shuffle; best for many small grids.
    "exploded": code-blocks are dealt out and decoded apart, then a grid's blocks meet
    again by a digest of its bytes, so rows need no key and equal streams give equal
    images; best for few large grids. "auto" looks at the declared sizes. A null content is
    a Codestream fault. FAILFAST raises whichever columns are selected. Columns of df that
    are named like those of the image are replaced by them.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if strategy == "auto":
        strategy = choose(df, content)
    out = (_exploded if strategy == "exploded" else _fused)(df, content, mode == "FAILFAST")
    return out.where("error IS NULL") if mode == "DROPMALFORMED" else out


def _failed(e: Exception, strict: bool) -> tuple:
    fault = _fault(e)
    if strict:
        raise ValueError(f"malformed codestream: {fault['kind']}: {fault['message']}") from e
    return None, None, None, None, None, fault


class _Lost(Exception):
    """Not a fault of the stream."""


#: Bytes of samples in a batch of images; a larger image is a batch of its own.
BATCH_BYTES = 4 << 20


def _fused(df: DataFrame, content: str, strict: bool = False) -> DataFrame:
    names, kept = _columns(df, content, tuple(n for n, _ in _IMAGE_KINDS))

    def run(batches):
        for batch in batches:
            rows, begin, size = [], 0, 0
            for i in range(batch.num_rows):
                x = batch.column(batch.schema.get_field_index(content))[i].as_py()
                try:
                    if x is None:
                        raise Fault("Codestream", "no bytes")
                    rows.append(_image(*grid.decode(x)))
                except Exception as e:
                    rows.append(_failed(e, strict))
                size += 4 * len(rows[-1][4]) if rows[-1][4] is not None else 0
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_pydict(_kept(batch.slice(begin, len(rows)), names) | _image_columns(rows))
                    rows, begin, size = [], i + 1, 0

    return df.select(*names, content).mapInArrow(run, kept + IMAGE)


def _exploded(df: DataFrame, content: str, strict: bool = False) -> DataFrame:
    stream, found = "_gridwave_stream", "_gridwave_blocks"
    digest = F.sha2(F.col(content), 256)
    blocks = code_blocks(df.where(F.col(content).isNotNull()).select(digest.alias(stream), F.col(content).alias("content")))

    def entropy(batches):
        for b in batches:
            out = []
            for seg, w, h, kind, planes, zero, passes in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("segment", "w", "h", "kind", "planes", "zero_bit_planes", "num_passes"))):
                if seg is None or planes - zero > grid.MAX_PLANES:
                    out.append(None)
                else:
                    out.append(grid.decode_block(seg, w, h, kind, planes, zero, passes).ravel().astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict(_kept(b, [stream, "band_idx", "block_idx", "x", "y", "w", "h"]) | {"q": pa.array(out, pa.binary())})

    parts = df.sparkSession.sparkContext.defaultParallelism
    spread = blocks.repartition(parts, stream, "band_idx", "block_idx")
    q = spread.mapInArrow(entropy, f"{stream} string, band_idx int, block_idx int, x int, y int, w int, h int, q binary")
    # equal streams in several rows give each block once more; one of them is enough
    q = q.groupBy(stream, "band_idx", "block_idx").agg(F.first(F.struct("band_idx", "x", "y", "w", "h", "q")).alias("_b"))
    images = q.groupBy(stream).agg(F.collect_list("_b").alias(found))
    whole = df.withColumn(stream, digest).join(images, stream, "left").drop(stream)
    others, kept_all = _columns(whole, content, (*(n for n, _ in _IMAGE_KINDS), found))

    def gather(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row, own = (one.column(one.schema.get_field_index(n))[0].as_py() for n in (content, found))
                try:
                    if row is None:
                        raise Fault("Codestream", "no bytes")
                    head, bands, blocks = _packets(row)
                    values = [np.zeros((b.h, b.w), np.int64) for b in bands]
                    for b in bands:
                        grid.bit_planes(head.qcd, b.index)
                    own = [b for b in own or [] if b["band_idx"] is not None]
                    if len(own) != sum(b.passes > 0 for b in blocks):
                        raise _Lost("code-blocks are missing")
                    for b in own:
                        if b["q"] is None:
                            raise Fault("Unsupported", "bit-planes")
                        values[b["band_idx"]][b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]] = np.frombuffer(b["q"], "<i4").reshape(b["h"], b["w"])
                    samples = grid.assemble(head, grid.reconstruct(grid.dequantize(head, bands, values), head.cod["transform"]))
                    image = _image(head, samples)
                except _Lost:
                    raise
                except Exception as e:
                    image = _failed(e, strict)
                yield pa.RecordBatch.from_pydict(_kept(one, others) | _image_columns([image]))

    return whole.select(*others, content, found).mapInArrow(gather, kept_all + IMAGE)


def images_to_samples(images: DataFrame) -> DataFrame:
    """A row per sample: the other columns of the images, x, y and value."""
    others = [c for c in images.columns if c not in ("width", "height", "bit_depth", "signed", "samples", "error")]
    long_ = images.where("error IS NULL").select(*others, "width", F.posexplode("samples").alias("_i", "value"))
    return long_.select(*others, (F.col("_i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), "value")


def supported(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose SIZ is within the subset, by a filter that needs no Python."""
    return df.where(siz_fields(content).isNotNull() & geometry_fault(siz_fields(content)).isNull())
