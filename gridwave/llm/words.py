"""Vectorised scanning of many texts at once: words, word hashes and windows.

Texts are UTF-8 bytes laid end to end in one buffer with a line feed after each,
so no word crosses two texts. Hashes are 64 bits and depend on the bytes alone, so
every executor computes the same ones.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
#: Longer words are hashed one by one.
LONG_WORD = 48

_bytes = np.arange(256)
FOLD = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
KEEP = _bytes.astype(np.uint8)
#: Anything but ASCII white space.
SPACED = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: ASCII letters and digits, and every byte of a character outside ASCII.
ALNUM = (_bytes >= 0x80) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = (h ^ (h >> _S32)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


class Words:
    """The words of a list of texts.

    start, end: places in buf; hash: 64-bit hashes of the folded words;
    first: the word range of text i is first[i]:first[i + 1];
    offset: text i begins at buf[offset[i]].
    """

    def __init__(self, texts: list[bytes], word: np.ndarray = SPACED, fold: np.ndarray = KEEP, hashes: bool = True):
        self.n_texts = len(texts)
        raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.is_word = word[self.buf]
        flips = np.flatnonzero(self.is_word[1:] != self.is_word[:-1]) + 1
        if self.is_word[0]:
            flips = np.concatenate(([0], flips))
        self.start, self.end = flips[0::2], flips[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.hash = self._hash(fold[self.buf], raw, fold) if hashes else None

    def _hash(self, folded: np.ndarray, raw: bytes, fold: np.ndarray) -> np.ndarray:
        length = self.end - self.start
        order = np.argsort(np.minimum(length, LONG_WORD + 1).astype(np.uint8), kind="stable")[::-1]
        at, size = self.start[order], length[order]
        h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
        short = int(np.searchsorted(-np.minimum(size, LONG_WORD + 1), -LONG_WORD)) if len(size) else 0
        live = np.searchsorted(-size[short:], -np.arange(1, LONG_WORD + 1), side="right") + short if len(size) else []
        with np.errstate(over="ignore"):
            for j, stop in enumerate(live):
                if stop <= short:
                    break
                part = (h[short:stop] ^ folded[at[short:stop] + j]) * _M1
                h[short:stop] = part ^ (part >> _S32)
            h = mix(h)
        table = fold.tobytes()
        for i in range(short):
            h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + size[i]].translate(table))
        out = np.empty_like(h)
        out[order] = h
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value per byte of buf."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.offset[1:] - 1] - total[self.offset[:-1]]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many consecutive words, across texts too; mask those that cross."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix(h[:n])
        for k in range(1, size):
            out = mix(out * _M1 + h[k : k + n])
    return out


def one_hash(h: np.ndarray) -> int:
    """A hash of one whole sequence, apart from all window hashes of other lengths."""
    with np.errstate(over="ignore"):
        out = mix(np.array([0x1234567 + len(h)], np.uint64))
        for x in h:
            out = mix(out * _M1 + x)
    return int(out[0])


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles; with fewer words, its whole sequence."""
    all_ = windows(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= size:
            s = np.sort(all_[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(np.array([one_hash(words.hash[a:b])], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def pieces_of(rows, sizes, limit: int):
    """Slices of a list whose sizes add up to the limit at most, with one element at least."""
    begin = total = 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > limit:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(rows):
        yield begin, len(rows)
