"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over bytes. Where the walk can't go on, a failure link leads to
the node that stands for what is left once the longest matches of the walked text have
been popped, and a number precomputed with the link says how many tokens those were. So
a word's count takes steps in proportion to its length, and no piece is ever built.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import as_bytes, map_texts


class MatchCounter:
    """Counts of greedy longest-match pieces over a vocabulary of byte strings.

    A word is written with `lead` before it, as byte-level vocabularies mark its start.
    A word that the vocabulary can't cover counts as one unknown token.
    """

    def __init__(self, vocabulary: set[bytes], lead: bytes = b" ", memory: int = 500_000):
        self.lead, self.memory, self.known = lead, memory, {}
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for token in sorted(vocabulary):
            at = 0
            for b in token:
                to = self.next[at].get(b)
                if to is None:
                    to = len(self.next)
                    self.next[at][b] = to
                    self.next.append({})
                    ends.append(False)
                at = to
            ends[at] = at != 0
        # breadth first; a link is -1 where no pieces can be popped
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = [0]
        for at in queue:
            for b, to in self.next[at].items():
                queue.append(to)
                if ends[to]:  # the walked text is a token itself
                    self.link[to], self.popped[to] = 0, 1
                    continue
                back, many = self.link[at], self.popped[at]
                while back >= 0 and b not in self.next[back]:
                    many += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[to], self.popped[to] = self.next[back][b], many

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 if it can't be covered."""
        nxt, link, popped = self.next, self.link, self.popped
        at = total = 0
        for b in self.lead + word:
            while b not in nxt[at]:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = nxt[at][b]
        while at:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return total

    def of_text(self, text: bytes) -> tuple[int, int]:
        """Words and pieces of a text."""
        known, words, total = self.known, text.split(), 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= 64:
                    if len(known) >= self.memory:
                        known.clear()
                    known[w] = n
            total += n
        return len(words), total


def read_ranks(path: str) -> set[bytes]:
    """The byte strings of a .tiktoken vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(line.split()[0]) for line in f if line.strip()}


_counters: dict[str, MatchCounter] = {}


def counter(path: str) -> MatchCounter:
    """One a worker process, kept between batches."""
    if path not in _counters:
        _counters[path] = MatchCounter(read_ranks(path))
    return _counters[path]


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) per document, in one pass without a shuffle.

    Words are runs of anything but ASCII white space; each is cut greedily into the longest
    pieces, of equal ones there is but one. A null text counts as empty (0 and 0); a text of
    any length is read whole, in memory in proportion to it. Null or repeated ids give a row
    each; empty input gives no rows; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        count = counter(vocabulary).of_text
        for batch in batches:
            got = [count(t or b"") for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_words": pa.array([w for w, _ in got], pa.int64()), "n_tokens": pa.array([n for _, n in got], pa.int64())})

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
