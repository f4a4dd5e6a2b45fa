"""The MQ arithmetic coder (ITU-T T.88 Annex E, ISO/IEC 15444-1 Annex C)."""

from __future__ import annotations

# fixed values: Qe, next state after an MPS and an LPS, and whether the MPS changes
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
#: By 2 * state + MPS: Qe, that number after an MPS and after an LPS.
_MOVES = [(q, 2 * nm + mps, 2 * nl + (mps ^ sw)) for q, nm, nl, sw in STATES for mps in (0, 1)]


def decoder(data: bytes, contexts: list[int]):
    """A function context -> decision; contexts hold 2 * state + MPS and are changed in place."""
    c = at = 0
    a, left = 0x8000, 0

    def more():
        nonlocal c, at, left
        this = data[at] if at < len(data) else 0xFF
        ahead = data[at + 1] if at + 1 < len(data) else 0xFF
        if this == 0xFF and ahead > 0x8F:
            c += 0xFF00
            left = 8
        else:
            at += 1
            c += ahead << (9 if this == 0xFF else 8)
            left = 7 if this == 0xFF else 8

    c = (data[0] if data else 0xFF) << 16
    more()
    c = c << 7 & 0xFFFFFFFF
    left -= 7

    def decide(k: int, _wanted: int = 0) -> int:
        nonlocal a, c, left
        i = contexts[k]
        q, after_mps, after_lps = _MOVES[i]
        a -= q
        if c >> 16 < q:  # the lower interval
            lps = a >= q
            a = q
        else:
            c -= q << 16
            if a & 0x8000:
                return i & 1
            lps = a < q
        contexts[k] = after_lps if lps else after_mps
        while True:
            if not left:
                more()
            a <<= 1
            c = c << 1 & 0xFFFFFFFF
            left -= 1
            if a & 0x8000:
                return i & 1 ^ lps

    return decide


class Encoder:
    """The matching encoder; done() gives the terminated segment."""

    def __init__(self, contexts: list[int]):
        self.contexts, self.out = contexts, bytearray(b"\0")
        self.a, self.c, self.left = 0x8000, 0, 12

    def __call__(self, k: int, d: int) -> int:
        i = self.contexts[k]
        q, after_mps, after_lps = _MOVES[i]
        self.a -= q
        if d == (i & 1):
            if self.a & 0x8000:
                self.c += q
                return d
            if self.a < q:
                self.a = q
            else:
                self.c += q
            self.contexts[k] = after_mps
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            self.contexts[k] = after_lps
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
            if not self.left:
                self._byte()
        return d

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c > 0x7FFFFFF:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c &= 0xFFFFF
            self.left = 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c &= 0x7FFFF
            self.left = 8

    def done(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.left
            self._byte()
        return bytes(self.out[1:] if self.out[-1] != 0xFF else self.out[1:-1])
