"""Main header and tile-part of a codestream (ISO/IEC 15444-1 Annex A)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .faults import codestream, marker, unsupported

# fixed values: marker codes
SOC, SOT, SOD, EOC = 0xFF4F, 0xFF90, 0xFF93, 0xFFD9
SIZ, COD, COC, QCD, QCC, RGN, POC = 0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5E, 0xFF5F
TLM, PLT, SOP, EPH, COM = 0xFF55, 0xFF58, 0xFF91, 0xFF92, 0xFF64
MAIN_UNSUPPORTED = frozenset((COC, QCC, RGN, POC, TLM, PLT, SOP, EPH))
TILE_UNSUPPORTED = MAIN_UNSUPPORTED | {COD, QCD}
TRANSFORMS = ("9-7", "5-3")
PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
QUANT_STYLES = ("none", "derived", "expounded")
MAX_AREA = 1 << 26
#: Code-block style flags that change nothing for this decoder.
HARMLESS_STYLES = 0x10


class Fields:
    """Big-endian fields of a byte range; reading past its end is a fault."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise codestream(f"{n} bytes wanted at {self.at}, {self.end - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return int.from_bytes(self.take(2))

    def u32(self) -> int:
        return int.from_bytes(self.take(4))

    def segment(self) -> Fields:
        """The body of a marker segment; its length counts itself."""
        size = self.u16()
        if size < 2:
            raise codestream("segment length below 2")
        begin = self.at
        self.take(size - 2)
        return Fields(self.data, begin, self.at)

    def done(self, what: str) -> None:
        if self.at != self.end:
            raise codestream(f"{self.end - self.at} bytes left in {what}")


@dataclass
class Header:
    siz: dict = field(default_factory=dict)
    cod: dict | None = None
    qcd: dict | None = None
    packet_off: int = 0
    packet_len: int = 0

    @property
    def width(self) -> int:
        return -(-self.siz["x_size"] // max(self.siz["x_sampling"], 1))

    @property
    def height(self) -> int:
        return -(-self.siz["y_size"] // max(self.siz["y_sampling"], 1))


def read_siz(f: Fields) -> dict:
    f.u16()  # capabilities are not looked at
    names = ("x_size", "y_size", "x_off", "y_off", "tile_w", "tile_h", "tile_x_off", "tile_y_off")
    s = dict(zip(names, struct.unpack(">8I", f.take(32))))
    n = f.u16()
    if n == 0:
        raise marker("no component")
    if n != 1:
        raise unsupported(f"{n} components")
    depth = f.u8()
    s |= {"bit_depth": (depth & 0x7F) + 1, "signed": bool(depth & 0x80), "x_sampling": f.u8(), "y_sampling": f.u8()}
    f.done("SIZ")
    check_geometry(s)
    return s


def check_geometry(s: dict) -> None:
    if not (s["x_size"] and s["y_size"]):
        raise marker("an empty image")
    if s["x_off"] or s["y_off"] or s["tile_x_off"] or s["tile_y_off"]:
        raise unsupported("image or tile offset")
    if not (s["tile_w"] and s["tile_h"]):
        raise marker("an empty tile")
    if s["tile_w"] < s["x_size"] or s["tile_h"] < s["y_size"]:
        raise unsupported("more than one tile")
    if s["x_size"] * s["y_size"] > MAX_AREA:
        raise unsupported("image area")


def read_cod(f: Fields) -> dict:
    flags = f.u8()
    if flags & 0x01:
        raise unsupported("precincts")
    if flags & 0x06:
        raise unsupported("SOP or EPH markers")
    order = f.u8()
    if order > 4:
        raise marker(f"progression {order}")
    if order:
        raise unsupported(f"progression {PROGRESSIONS[order]}")
    layers = f.u16()
    if layers != 1:
        raise unsupported(f"{layers} layers")
    if f.u8():
        raise unsupported("component transform")
    levels, xcb, ycb, style, kind = f.take(5)
    if kind > 1:
        raise marker(f"wavelet {kind}")
    f.done("COD")
    return {"progression": "LRCP", "layers": 1, "levels": levels, "xcb": xcb, "ycb": ycb, "style": style, "transform": TRANSFORMS[kind]}


def read_qcd(f: Fields) -> dict:
    first = f.u8()
    kind = first & 0x1F
    if kind > 2:
        raise marker(f"quantization style {kind}")
    body = f.take(f.end - f.at)
    if kind == 0:
        steps = [(v >> 3, 0) for v in body]
    elif len(body) % 2 or (kind == 1 and len(body) != 2):
        raise codestream("step table")
    else:
        steps = [(v >> 11, v & 0x7FF) for (v,) in struct.iter_unpack(">H", body)]
    if not steps:
        raise codestream("no steps")
    return {"style": QUANT_STYLES[kind], "guard_bits": first >> 5, "steps": steps}


def parse(data: bytes) -> Header:
    """The header and the bounds of the packets; a Fault for anything outside the subset."""
    f, h = Fields(data), Header()
    if f.u16() != SOC:
        raise codestream("no SOC")
    if f.u16() != SIZ:
        raise codestream("SIZ is not first")
    h.siz = read_siz(f.segment())
    while (m := f.u16()) != SOT:
        if m == COD:
            if h.cod:
                raise codestream("second COD")
            h.cod = read_cod(f.segment())
        elif m == QCD:
            if h.qcd:
                raise codestream("second QCD")
            h.qcd = read_qcd(f.segment())
        elif m == COM:
            f.segment()
        elif m in MAIN_UNSUPPORTED:
            raise unsupported(f"marker {m:04x}")
        else:
            raise codestream(f"marker {m:04x} in the main header")
    if not h.cod or not h.qcd:
        raise codestream("COD or QCD is missing")
    if h.cod["style"] & ~HARMLESS_STYLES:
        raise unsupported("code-block style")
    _tile_part(data, f, h)
    return h


def _tile_part(data: bytes, f: Fields, h: Header) -> None:
    sot = f.at - 2
    s = f.segment()
    tile, size, part, parts = struct.unpack(">HIBB", s.take(8))
    s.done("SOT")
    if tile or part or parts > 1:
        raise unsupported("several tiles or tile-parts")
    while (m := f.u16()) != SOD:
        if m == COM:
            f.segment()
        elif m in TILE_UNSUPPORTED:
            raise unsupported(f"marker {m:04x} in a tile-part")
        else:
            raise codestream(f"marker {m:04x} in a tile-part")
    end = sot + size if size else len(data) - 2
    if end > len(data) or end < f.at:
        raise codestream("tile-part length")
    after = int.from_bytes(data[end : end + 2]) if end + 2 <= len(data) else None
    if after == SOT and size:
        raise unsupported("several tile-parts")
    if after != EOC:
        raise codestream("no EOC")
    h.packet_off, h.packet_len = f.at, end - f.at
