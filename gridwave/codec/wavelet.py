"""5/3 and 9/7 lifting on NumPy, along the last axis or in two dimensions (Annex F)."""

from __future__ import annotations

import numpy as np

# fixed values: Table F.4 in single precision
ALPHA, BETA, GAMMA, DELTA, K = (np.float32(x) for x in (-1.586_134_3, -0.052_980_12, 0.882_911_1, 0.443_506_85, 1.230_174_1))


def _lift(x: np.ndarray, parity: int, change) -> None:
    """x[parity::2] += change(left + right), with whole-sample mirroring at the ends."""
    n = x.shape[-1]
    own = np.arange(parity, n, 2)
    left, right = np.abs(own - 1), np.where(own + 1 < n, own + 1, 2 * (n - 1) - own - 1)
    x[..., parity::2] += change(x[..., left] + x[..., right])


def inverse_53(x: np.ndarray) -> np.ndarray:
    """Exact; 64-bit integers, shifts round down."""
    x = x.astype(np.int64)
    if x.shape[-1] > 1:
        _lift(x, 0, lambda s: -((s + 2) >> 2))
        _lift(x, 1, lambda s: s >> 1)
    return x


def forward_53(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    if x.shape[-1] > 1:
        _lift(x, 1, lambda s: -(s >> 1))
        _lift(x, 0, lambda s: (s + 2) >> 2)
    return x


def inverse_97(x: np.ndarray) -> np.ndarray:
    """Single precision throughout."""
    x = x.astype(np.float32)
    if x.shape[-1] > 1:
        x[..., 0::2] *= K
        x[..., 1::2] *= np.float32(1) / K
        for parity, c in ((0, -DELTA), (1, -GAMMA), (0, -BETA), (1, -ALPHA)):
            _lift(x, parity, lambda s, c=c: c * s)
    return x


def forward_97(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    if x.shape[-1] > 1:
        for parity, c in ((1, ALPHA), (0, BETA), (1, GAMMA), (0, DELTA)):
            _lift(x, parity, lambda s, c=c: c * s)
        x[..., 0::2] *= np.float32(1) / K
        x[..., 1::2] *= K
    return x


INVERSE = {"5-3": inverse_53, "9-7": inverse_97}
FORWARD = {"5-3": forward_53, "9-7": forward_97}


def merge(ll: np.ndarray, hl: np.ndarray, lh: np.ndarray, hh: np.ndarray, transform: str) -> np.ndarray:
    """One level up: bands interleaved, then rows, then columns."""
    grid = np.zeros((ll.shape[0] + lh.shape[0], ll.shape[1] + hl.shape[1]), ll.dtype)
    grid[0::2, 0::2], grid[0::2, 1::2], grid[1::2, 0::2], grid[1::2, 1::2] = ll, hl, lh, hh
    f = INVERSE[transform]
    return f(f(grid).T).T


def split(grid: np.ndarray, transform: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One level down: columns, then rows, then LL, HL, LH, HH."""
    f = FORWARD[transform]
    grid = f(f(grid.T).T)
    return grid[0::2, 0::2], grid[0::2, 1::2], grid[1::2, 0::2], grid[1::2, 1::2]


def to_samples(x: np.ndarray) -> np.ndarray:
    """Halves away from zero, saturated to 32 bits."""
    r = np.trunc(np.abs(x.astype(np.float64)) + 0.5) * np.sign(x)
    return np.clip(np.nan_to_num(r), -(2.0**31), 2.0**31 - 1).astype(np.int64)
