"""From a codestream to samples and back."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from . import headers, wavelet
from .bits import BitReader, BitWriter, TagTree, read_passes, write_passes
from .blocks import MAX_PLANES, decode_block, encode_block
from .faults import codestream, inconsistent, marker, unsupported

_GAIN = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}
ZERO_PLANES_LIMIT, LBLOCK_LIMIT = 64, 24


@dataclass
class BandGrid:
    """A subband: res 0 is LL; size, and its code-blocks as (x, y, w, h) in row order."""

    index: int
    res: int
    kind: str
    w: int
    h: int
    cols: int
    rows: int
    blocks: list[tuple[int, int, int, int]]


def band_grids(width: int, height: int, levels: int, xcb: int, ycb: int) -> list[BandGrid]:
    """All subbands of a single tile at the origin, coarsest first."""
    if levels > 32:
        raise unsupported(f"{levels} levels")
    if not (width and height):
        raise codestream("an empty tile")
    if xcb > 8 or ycb > 8 or xcb + ycb > 8:
        raise marker("code-block size")
    bw, bh = 1 << xcb + 2, 1 << ycb + 2
    out = []
    for res in range(levels + 1):
        for kind in ("LL",) if res == 0 else ("HL", "LH", "HH"):
            nb = levels if res == 0 else levels - res + 1
            half = 1 << nb - 1 if res else 0
            xo, yo = (kind in ("HL", "HH")) * half, (kind in ("LH", "HH")) * half
            w, h = max(0, -((xo - width) >> nb)), max(0, -((yo - height) >> nb))
            cols, rows = (-(-w // bw), -(-h // bh)) if w and h else (0, 0)
            blocks = [(x, y, min(bw, w - x), min(bh, h - y)) for y in range(0, h if cols else 0, bh) for x in range(0, w, bw)]
            out.append(BandGrid(len(out), res, kind, w, h, cols, rows, blocks))
    return out


@dataclass
class CodeBlock:
    band: int
    index: int
    x: int
    y: int
    w: int
    h: int
    passes: int
    zero_planes: int
    offset: int
    length: int


def read_packets(data: bytes, bands: list[BandGrid], start: int, end: int) -> list[CodeBlock]:
    """All code-blocks with the bounds of their segments in data; packets fill the range exactly."""
    found, at = [], start
    for res in range(bands[-1].res + 1):
        own = [b for b in bands if b.res == res]
        bits, heads = BitReader(data[:end], at), []
        if bits.bit():
            for band in own:
                heads += _band_header(band, bits)
        else:
            heads = [(band, i, 0, 0, 0) for band in own for i in range(len(band.blocks))]
        at = bits.align()
        for band, i, passes, zero, size in heads:
            if passes and not size:
                raise codestream("passes without bytes")
            if at + size > end:
                raise codestream("a segment overruns")
            found.append(CodeBlock(band.index, i, *band.blocks[i], passes, zero, at, size))
            at += size
    if at != end:
        raise codestream(f"{end - at} bytes after the packets")
    return found


def _band_header(band: BandGrid, bits: BitReader) -> list[tuple]:
    if not band.blocks:
        return []
    included, zeros, out = TagTree(band.cols, band.rows), TagTree(band.cols, band.rows), []
    for i in range(len(band.blocks)):
        x, y = i % band.cols, i // band.cols
        if included.read(x, y, 1, bits) is None:
            out.append((band, i, 0, 0, 0))
            continue
        zero = zeros.read(x, y, ZERO_PLANES_LIMIT, bits)
        if zero is None:
            raise codestream("zero bit-planes")
        passes, lblock = read_passes(bits), 3
        while bits.bit():
            lblock += 1
            if lblock > LBLOCK_LIMIT:
                raise codestream("Lblock")
        out.append((band, i, passes, zero, bits.bits(lblock + passes.bit_length() - 1)))
    return out


def band_step(qcd: dict, index: int) -> tuple[int, int] | None:
    """Exponent and mantissa of a band; derived styles lower the first exponent level by level."""
    if qcd["style"] == "derived":
        e, m = qcd["steps"][0]
        return max(0, e - max(index - 1, 0) // 3), m
    return qcd["steps"][index] if index < len(qcd["steps"]) else None


def bit_planes(qcd: dict, index: int) -> int:
    """Mb of a band."""
    step = band_step(qcd, index)
    if step is None:
        raise inconsistent(f"no step for band {index}")
    return max(qcd["guard_bits"] + step[0] - 1, 0)


def decode_coefficients(data: bytes, head: headers.Header, bands: list[BandGrid], blocks: list[CodeBlock]) -> list[np.ndarray]:
    """Quantized coefficients of each band."""
    out = []
    by: dict[int, list[CodeBlock]] = {}
    for b in blocks:
        by.setdefault(b.band, []).append(b)
    for band in bands:
        grid, planes = np.zeros((band.h, band.w), np.int64), bit_planes(head.qcd, band.index)
        for b in by.get(band.index, []):
            if b.passes:
                if planes - b.zero_planes > MAX_PLANES:
                    raise unsupported("bit-planes")
                grid[b.y : b.y + b.h, b.x : b.x + b.w] = decode_block(data[b.offset : b.offset + b.length], b.w, b.h, band.kind, planes, b.zero_planes, b.passes)
        out.append(grid)
    return out


def step_size(step: tuple[int, int], depth: int, kind: str) -> float:
    return (1 + step[1] / 2048) * 2.0 ** (depth + _GAIN[kind] - step[0])


def dequantize(head: headers.Header, bands: list[BandGrid], coefficients: list[np.ndarray]) -> list[np.ndarray]:
    if head.cod["transform"] == "5-3":
        return coefficients
    q = head.qcd
    if q["style"] == "none" or (q["style"] == "expounded" and len(q["steps"]) != len(bands)):
        raise inconsistent("steps")
    out = []
    for band, c in zip(bands, coefficients):
        delta = step_size(band_step(q, band.index), head.siz["bit_depth"], band.kind)
        out.append((np.sign(c) * (np.abs(c) + 0.5) * delta).astype(np.float32))
    return out


def reconstruct(bands: list[np.ndarray], transform: str) -> np.ndarray:
    grid = bands[0]
    for k in range(1, len(bands), 3):
        grid = wavelet.merge(grid, *bands[k : k + 3], transform)
    return grid if transform == "5-3" else wavelet.to_samples(grid)


def assemble(head: headers.Header, grid: np.ndarray) -> np.ndarray:
    """Level shift and clamp."""
    s = head.siz
    depth = s["bit_depth"]
    if not 1 <= depth <= 32:
        raise marker(f"depth {depth}")
    if not (s["x_sampling"] and s["y_sampling"]):
        raise marker("sub-sampling")
    if grid.size != head.width * head.height:
        raise inconsistent("sample count")
    if depth == 32 and not s["signed"]:
        raise unsupported("unsigned 32-bit samples")
    half = 1 << depth - 1
    return np.clip(grid, -half, half - 1) if s["signed"] else np.clip(grid + half, 0, 2 * half - 1)


def decode(data: bytes) -> tuple[headers.Header, np.ndarray]:
    """Header and samples, as (height, width)."""
    head = headers.parse(data)
    c = head.cod
    bands = band_grids(head.width, head.height, c["levels"], c["xcb"], c["ycb"])
    blocks = read_packets(data, bands, head.packet_off, head.packet_off + head.packet_len)
    values = dequantize(head, bands, decode_coefficients(data, head, bands, blocks))
    return head, assemble(head, reconstruct(values, c["transform"]))


def encode(samples: np.ndarray, depth: int = 8, signed: bool = False, levels: int = 2, transform: str = "5-3", xcb: int = 4, ycb: int = 4, guard: int = 2) -> bytes:
    """A codestream of the decoded subset; 5/3 is lossless, 9/7 has a step of about 1/16."""
    height, width = samples.shape
    grid = samples.astype(np.int64) - (0 if signed else 1 << depth - 1)
    grids = band_grids(width, height, levels, xcb, ycb)
    parts: list[np.ndarray] = []
    rest = grid if transform == "5-3" else grid.astype(np.float32)
    for _ in range(levels):
        rest, *detail = wavelet.split(rest, transform)
        parts = detail + parts
    parts = [rest, *parts]
    if transform == "5-3":
        steps, style = [(depth + _GAIN[b.kind], 0) for b in grids], 0
        qcd = bytes([guard << 5 | style]) + bytes(e << 3 for e, _ in steps)
    else:
        steps, style = [(depth + _GAIN[b.kind] + 4, 0) for b in grids], 2
        qcd = bytes([guard << 5 | style]) + b"".join(struct.pack(">H", e << 11 | m) for e, m in steps)
        parts = [(np.sign(p) * np.floor(np.abs(p) / step_size(s, depth, b.kind))).astype(np.int64) for p, s, b in zip(parts, steps, grids)]
    body = b""
    for res in range(levels + 1):
        own = [b for b in grids if b.res == res]
        bits, segments = BitWriter(), []
        bits.bit(1)
        for band in own:
            planes = guard + steps[band.index][0] - 1
            coded = [encode_block(parts[band.index][y : y + h, x : x + w], band.kind, planes) for x, y, w, h in band.blocks]
            if any(z < 0 for _, z, _ in coded):
                raise ValueError("more bit-planes than the guard bits allow")
            if not coded:
                continue
            included = TagTree(band.cols, band.rows, [int(not p) for *_, p in coded])
            zeros = TagTree(band.cols, band.rows, [z for _, z, _ in coded])
            for i, (segment, zero, passes) in enumerate(coded):
                x, y = i % band.cols, i // band.cols
                included.write(x, y, 1, bits)
                if passes:
                    zeros.write(x, y, zero + 1, bits)
                    write_passes(passes, bits)
                    free = passes.bit_length() - 1
                    grow = max(0, len(segment).bit_length() - free - 3)
                    bits.bits((1 << grow) - 1, grow), bits.bit(0)
                    bits.bits(len(segment), 3 + grow + free)
                    segments.append(segment)
        body += bits.done() + b"".join(segments)

    def mark(code: int, payload: bytes) -> bytes:
        return struct.pack(">HH", code, len(payload) + 2) + payload

    siz = struct.pack(">H8IH3B", 0, width, height, 0, 0, width, height, 0, 0, 1, depth - 1 | (0x80 if signed else 0), 1, 1)
    cod = bytes([0, 0, 0, 1, 0, levels, xcb, ycb, 0, headers.TRANSFORMS.index(transform)])
    head = struct.pack(">H", headers.SOC) + mark(headers.SIZ, siz) + mark(headers.COD, cod) + mark(headers.QCD, qcd)
    sot = mark(headers.SOT, struct.pack(">HIBB", 0, 14 + len(body), 0, 1))
    return head + sot + struct.pack(">H", headers.SOD) + body + struct.pack(">H", headers.EOC)
