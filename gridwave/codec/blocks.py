"""Code-blocks (Annex D): bit-plane passes over an MQ coder.

One description of the passes serves both ways: `code(context, decision)` returns the
decoded decision, or takes the one to encode. Each sample keeps which neighbours are
significant in one integer, so that every context is a table look-up.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import mq

ZC, SC, MR, RUN, UNI = 0, 9, 14, 17, 18
# neighbour bits: W E N S, then NW NE SW SE; in bits 8-11 the signs of W E N S
_W, _E, _N, _S, _DIAGONAL, _SIGNS = 1, 2, 4, 8, 0xF0, 8
MAX_PLANES = 30


def initial_contexts() -> list[int]:
    out = [0] * 19
    out[ZC], out[RUN], out[UNI] = 2 * 4, 2 * 3, 2 * 46
    return out


def zero_context(h: int, v: int, d: int, kind: str) -> int:
    """Table D.1."""
    if kind == "HH":
        s = h + v
        if d >= 3:
            return 8
        return (6, 7, 7)[min(s, 2)] if d == 2 else min(s, 2) + (3 if d else 0)
    if kind == "HL":
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return 2 + v if v else min(d, 2)


def sign_context(h: int, v: int) -> tuple[int, int]:
    """Context and flip by the contributions -1, 0 or 1 (Tables D.2 and D.3)."""
    flip = h < 0 or (h == 0 and v < 0)
    if flip:
        h, v = -h, -v
    return SC + (3 * h + v if h else v), int(flip)


@lru_cache(maxsize=4)
def _zero_table(kind: str) -> list[int]:
    return [ZC + zero_context((f & 1) + (f >> 1 & 1), (f >> 2 & 1) + (f >> 3 & 1), (f >> 4).bit_count(), kind) for f in range(256)]


def _sign_table() -> list[tuple[int, int]]:
    out = []
    for f in range(256):  # low bits: significance of W E N S; high bits: their signs
        part = [(f >> k & 1) * (1 - 2 * (f >> 4 + k & 1)) for k in range(4)]
        out.append(sign_context(max(-1, min(1, part[0] + part[1])), max(-1, min(1, part[2] + part[3]))))
    return out


_SIGN = _sign_table()


class _Passes:
    def __init__(self, w: int, h: int, kind: str, code, want: np.ndarray | None = None):
        self.w, self.h, self.code = w, h, code
        self.stride = s = w + 2
        size = s * (h + 2)
        self.flags = [0] * size
        self.sig, self.neg, self.seen, self.refined = (bytearray(size) for _ in range(4))
        self.mag = [0] * size
        self.zero = _zero_table(kind)
        self.around = ((1, _W, 256), (-1, _E, 512), (s, _N, 1024), (-s, _S, 2048), (s + 1, 16, 0), (s - 1, 32, 0), (-s + 1, 64, 0), (-s - 1, 128, 0))
        # when encoding: magnitudes and signs in the padded layout
        self.want_mag = self.want_neg = [0] * size
        if want is not None:
            grid = np.zeros((h + 2, s), np.int64)
            grid[1:-1, 1:-1] = want
            self.want_mag, self.want_neg = np.abs(grid).ravel().tolist(), (grid < 0).ravel().tolist()
        self.columns = [[(y + dy + 1) * s + x + 1 for dy in range(min(4, h - y))] for y in range(0, h, 4) for x in range(w)]

    def _found(self, i: int, plane: int) -> None:
        f = self.flags[i]
        k, flip = _SIGN[(f & 15) | (f >> _SIGNS & 15) << 4]
        neg = self.code(k, int(self.want_neg[i]) ^ flip) ^ flip
        self.sig[i], self.neg[i] = 1, neg
        self.mag[i] = 3 << plane >> 1  # the plane's bit and half of it
        for step, bit, sign in self.around:
            self.flags[i + step] |= bit | (sign if neg else 0)

    def propagation(self, plane: int) -> None:
        code, flags, zero, sig, seen = self.code, self.flags, self.zero, self.sig, self.seen
        want, shift = self.want_mag, plane - 1
        for column in self.columns:
            for i in column:
                if not sig[i] and (f := flags[i] & 255):
                    seen[i] = 1
                    if code(zero[f], want[i] >> shift & 1):
                        self._found(i, plane)

    def refinement(self, plane: int) -> None:
        code, flags, refined, sig, seen = self.code, self.flags, self.refined, self.sig, self.seen
        half = 1 << plane >> 1
        for column in self.columns:
            for i in column:
                if sig[i] and not seen[i]:
                    k = MR + 2 if refined[i] else MR + (flags[i] & 255 != 0)
                    self.mag[i] += half if code(k, self.want_mag[i] >> plane - 1 & 1) else -half
                    refined[i] = 1

    def cleanup(self, plane: int) -> None:
        code, flags, zero, sig, seen = self.code, self.flags, self.zero, self.sig, self.seen
        want, shift = self.want_mag, plane - 1
        for column in self.columns:
            todo = column
            if len(column) == 4 and not any(sig[i] or seen[i] or flags[i] & 255 for i in column):
                bits = [want[i] >> shift & 1 for i in column]
                if not code(RUN, int(any(bits))):
                    continue
                at = bits.index(1) if any(bits) else 0
                at = code(UNI, at >> 1) << 1 | code(UNI, at & 1)
                self._found(column[at], plane)
                todo = column[at + 1 :]
            for i in todo:
                if not sig[i] and not seen[i] and code(zero[flags[i] & 255], want[i] >> shift & 1):
                    self._found(i, plane)
        self.seen = bytearray(len(seen))

    def run(self, top: int, passes: int) -> None:
        """From plane `top` down to 1, a cleanup first, then three passes a plane."""
        self.cleanup(top)
        left = passes - 1
        for plane in range(top - 1, 0, -1):
            for step in (self.propagation, self.refinement, self.cleanup):
                if not left:
                    return
                step(plane)
                left -= 1

    def values(self) -> np.ndarray:
        """Signed coefficients; magnitudes were carried at twice their scale."""
        m = np.array(self.mag, np.int64).reshape(self.h + 2, self.stride)[1:-1, 1:-1] >> 1
        neg = np.frombuffer(bytes(self.neg), np.uint8).reshape(self.h + 2, self.stride)[1:-1, 1:-1]
        return np.where(neg == 1, -m, m)


def decode_block(segment: bytes, w: int, h: int, kind: str, planes: int, zero_planes: int, passes: int) -> np.ndarray:
    """Coefficients of one block; planes is the band's Mb."""
    top = planes - zero_planes
    if passes == 0 or top < 1:
        return np.zeros((h, w), np.int64)
    p = _Passes(w, h, kind, mq.decoder(segment, initial_contexts()))
    p.run(top, passes)
    return p.values()


def encode_block(values: np.ndarray, kind: str, planes: int) -> tuple[bytes, int, int]:
    """Segment, zero bit-planes and passes of a lossless coding."""
    top = int(np.abs(values).max(initial=0)).bit_length()
    if not top:
        return b"", planes, 0
    h, w = values.shape
    coder = mq.Encoder(initial_contexts())
    passes = 3 * top - 2
    _Passes(w, h, kind, coder, values).run(top, passes)
    return coder.done(), planes - top, passes
