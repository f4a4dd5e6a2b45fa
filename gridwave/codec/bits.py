"""Packet-header bits (Annex B.10): bit stuffing and tag trees, to read and to write."""

from __future__ import annotations

import math


class BitReader:
    """Most significant bit first; after a byte of ones the next one holds seven bits. Past the end all bits are 1."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.byte = self.left = 0

    def _load(self) -> None:
        self.left = 7 if self.byte == 0xFF else 8
        if self.at < len(self.data):
            self.byte = self.data[self.at]
            self.at += 1
        else:
            self.byte = 0xFF

    def bit(self) -> int:
        if not self.left:
            self._load()
        self.left -= 1
        return self.byte >> self.left & 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = 2 * v + self.bit()
        return v

    def align(self) -> int:
        """To the next byte, past the stuffed one if a byte of ones was last; its place."""
        if self.byte == 0xFF:
            self._load()
        self.left = 0
        return self.at


class BitWriter:
    def __init__(self):
        self.out, self.byte, self.left = bytearray(), 0, 8

    def bit(self, b: int) -> None:
        self.left -= 1
        self.byte |= b << self.left
        if not self.left:
            self._store()

    def _store(self) -> None:
        self.out.append(self.byte)
        self.left = 7 if self.byte == 0xFF else 8
        self.byte = 0

    def bits(self, v: int, n: int) -> None:
        for i in reversed(range(n)):
            self.bit(v >> i & 1)

    def done(self) -> bytes:
        full = 7 if self.out and self.out[-1] == 0xFF else 8
        if self.left != full or full == 7:
            self._store()
        return bytes(self.out)


class TagTree:
    """Levels of nodes, each over 2 x 2 of the level below; low holds what is known of a value."""

    def __init__(self, cols: int, rows: int, leaves: list[int] | None = None):
        self.shapes = [(cols, rows)]
        while math.prod(self.shapes[-1]) > 1:
            w, h = self.shapes[-1]
            self.shapes.append(((w + 1) // 2, (h + 1) // 2))
        self.low = [[0] * (w * h) for w, h in self.shapes]
        self.known = [[False] * (w * h) for w, h in self.shapes]
        self.value = [list(leaves)] if leaves is not None else []
        for (w, h), (pw, _) in zip(self.shapes[:-1] if self.value else [], self.shapes[1:]):
            below = self.value[-1]
            up = {}
            for i, v in enumerate(below):
                k = i // w // 2 * pw + i % w // 2
                up[k] = min(v, up.get(k, v))
            self.value.append([up[k] for k in sorted(up)])

    def _path(self, x: int, y: int):
        for level in reversed(range(len(self.shapes))):
            w, _ = self.shapes[level]
            yield level, (y >> level) * w + (x >> level)

    def read(self, x: int, y: int, threshold: int, source: BitReader) -> int | None:
        """The leaf's value if it lies below the threshold; goes on where earlier reads stopped."""
        low = 0
        for level, k in self._path(x, y):
            low = max(low, self.low[level][k])
            while low < threshold and not self.known[level][k]:
                if source.bit():
                    self.known[level][k] = True
                else:
                    low += 1
            if self.known[level][k]:
                low = max(low, self.low[level][k])
            self.low[level][k] = low
        return low if self.known[level][k] and low < threshold else None

    def write(self, x: int, y: int, threshold: int, sink: BitWriter) -> None:
        low = 0
        for level, k in self._path(x, y):
            low = max(low, self.low[level][k])
            while low < threshold and not self.known[level][k]:
                if self.value[level][k] <= low:
                    sink.bit(1)
                    self.known[level][k] = True
                else:
                    sink.bit(0)
                    low += 1
            self.low[level][k] = low


def read_passes(b: BitReader) -> int:
    """Number of coding passes (Table B.4)."""
    if not b.bit():
        return 1
    if not b.bit():
        return 2
    for base, n in ((3, 2), (6, 5)):
        v = b.bits(n)
        if v < (1 << n) - 1:
            return base + v
    return 37 + b.bits(7)


def write_passes(n: int, b: BitWriter) -> None:
    if n == 1:
        b.bit(0)
    elif n == 2:
        b.bits(0b10, 2)
    elif n < 6:
        b.bits(0b11, 2), b.bits(n - 3, 2)
    elif n < 37:
        b.bits(0b1111, 4), b.bits(n - 6, 5)
    else:
        b.bits(0b111111111, 9), b.bits(n - 37, 7)
