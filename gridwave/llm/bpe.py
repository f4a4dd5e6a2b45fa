"""Byte-level BPE ids of texts, from a tokenizers vocabulary file."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

# fixed values: the splitting pattern of the byte_bpe vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern looks ahead over white space and needs stack for each character of a run; longer runs are cut off by hand.
BLANKS = 10_000
_BLANK_RUN = re.compile(r"[^\S\x1c-\x1f]{%d,}" % BLANKS)


class Encoder:
    """ids(text) without special tokens, of texts of any length.

    The vocabulary is read from its JSON file and encoded by tiktoken, which merges by id
    and gives the same ids several times faster.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the file writes each byte as a printable character: itself, or one from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.ranks = {bytes(stand_in[c] for c in token): i for token, i in vocabulary.items() if token != "<|endoftext|>"}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) < BLANKS:
            return self._plain(text)
        parts, at = [], 0
        for m in _BLANK_RUN.finditer(text):
            # by the pattern a run is one piece, but its last character goes with what follows
            end = m.end() - (m.end() < len(text))
            parts += [self._plain(text[at : m.start()]), np.array(self.encoding._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        return np.concatenate([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, kept between batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
