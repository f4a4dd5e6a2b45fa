"""Benchmark decontamination with suffix arrays over the training texts.

Each task builds word-level suffix arrays of its own texts, a shard at a time, and looks
up every suffix of every benchmark item in all of them at once: the interval of matching
suffixes narrows word by word, so its last non-empty state is the longest verbatim match
and lists where it occurs. Item suffixes whose intervals are equal are one from there on,
so items that share a passage cost no more than one of them. Nothing is shuffled; a
shard's memory is bounded by its bytes.

The benchmark is cut into blocks of bounded bytes. They are broadcast as files, and a task
loads one at a time to search it in the array of its shard: more items make more blocks,
not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks, utf8, with_columns
from .words import ALNUM, FOLD, Words, pieces_of

#: Text of items in a block, of documents in a shard, and item names in a batch of results.
BLOCK_BYTES, SHARD_BYTES, BATCH_NAMES = 8 << 20, 2 << 20, 100_000


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes of a sequence of small non-negative numbers, in order.

    Prefix doubling; each round sorts only suffixes whose rank is still shared.
    """
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64)
    ids = ids.astype(np.int64)
    width = int(ids.max()) + 2
    key = ids * width + np.concatenate((ids[1:] + 1, [0]))
    order = np.argsort(key, kind="stable")
    k, shift = 2, key[order]
    rank = np.empty(n, np.int64)
    begin = np.concatenate(([True], shift[1:] != shift[:-1]))
    place = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    rank[order] = place
    while True:
        tied = ~begin
        tied[:-1] |= ~begin[1:]
        at = np.flatnonzero(tied)  # places in the order whose rank is shared
        if not len(at) or k >= n:
            return order
        members = order[at]
        nxt = members + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[members]
        o = np.lexsort((second, first))
        members, first, second = members[o], first[o], second[o]
        order[at] = members
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        begin[at] = fresh | begin[at]
        place = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[members] = place
        k *= 2


@dataclass
class Items:
    """A block of benchmark items as word hashes: suffix j belongs to item[j] and has left[j] words from it on.

    Items of one name are one; numbers are in the order of the names as strings.
    """

    names: list
    words: np.ndarray
    item: np.ndarray
    left: np.ndarray
    need: np.ndarray  # words that must match at this suffix for a window, or 0 if none begins here

    @classmethod
    def of(cls, names: list, texts: list, window: int) -> Items:
        pairs = sorted(zip(map(str, names), utf8(texts)))  # whatever the order of rows
        names, w = [n for n, _ in pairs], Words([t for _, t in pairs], ALNUM, FOLD)
        count = w.counts
        distinct = sorted(set(names))
        number = {n: i for i, n in enumerate(distinct)}
        item = np.repeat(np.array([number[n] for n in names], np.int32), count)
        left = np.concatenate([np.arange(c, 0, -1, dtype=np.int32) for c in count] or [np.empty(0, np.int32)])
        whole = np.repeat(count, count)
        need = np.where(whole < window, np.where(left == whole, whole, 0), np.where(left >= window, window, 0)).astype(np.int32)
        return cls(distinct, w.hash, item, left, need)


class Shard:
    """The suffix array of a few texts; a mark that no item holds stands after each."""

    def __init__(self, words: Words):
        n, k = len(words.hash), words.n_texts
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.n_words = n
        at = np.arange(n) + words.text_of_word()
        self.ids = np.zeros(n + k, np.int64)  # 0: a mark
        self.ids[at] = ids + 1
        self.text = np.zeros(n + k, np.int64)
        self.text[at] = words.text_of_word()
        self.word = np.full(n + k, -1)
        self.word[at] = np.arange(n)
        self.order = suffix_array(self.ids)

    def search(self, items: Items):
        """Narrows the intervals of all item suffixes at once.

        Yields (depth, suffixes, lo, hi): the suffixes that match so many words, and where
        in the order. Of one depth, two intervals are equal or have nothing in common.
        """
        if not len(self.vocabulary):
            return
        found = np.minimum(np.searchsorted(self.vocabulary, items.words), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[found] == items.words, found + 1, -1)
        live = np.flatnonzero(ids > 0)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.order))
        depth = 0
        while len(live):
            target = ids[live + depth]
            known = target > 0
            live, lo, hi, target = live[known], lo[known], hi[known], target[known]
            lo, hi = self._bound(lo, hi, target, depth, False), self._bound(lo, hi, target, depth, True)
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            depth += 1
            yield depth, live, lo, hi
            more = items.left[live] > depth
            live, lo, hi = live[more], lo[more], hi[more]

    def _bound(self, lo, hi, target, depth, right):
        lo, hi = lo.copy(), hi.copy()
        last = len(self.ids) - 1
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, last)] + depth
            value = np.where(at <= last, self.ids[np.minimum(at, last)], -1)
            below = (value <= target) if right else (value < target)
            lo = np.where(open_ & below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and which range each is of."""
    many = hi - lo
    which = np.repeat(np.arange(len(lo)), many)
    return np.arange(len(which)) + (lo - np.concatenate(([0], np.cumsum(many)[:-1])))[which] if len(lo) else np.empty(0, np.int64), which


class Overlap:
    """What the items of some blocks have in common with a shard."""

    def __init__(self, texts: list):
        self.words = Words(utf8(texts), ALNUM, FOLD)
        self.n = len(texts)
        size = len(self.words.hash)
        self.shard = Shard(self.words) if size else None
        self.change = np.zeros(size + 1, np.int64)
        self.names: list[tuple] = [()] * self.n
        self.longest, self.item, self.at = np.zeros(self.n, np.int64), [None] * self.n, np.zeros(self.n, np.int64)

    def add(self, items: Items) -> None:
        if self.shard is None or not len(items.words):
            return
        shard, size = self.shard, len(self.shard.order)
        best, whose = np.zeros(size, np.int32), np.zeros(size, np.int32)
        found = []  # (text, class of windows)
        classes: dict[bytes, int] = {}
        for depth, suffix, lo, hi in shard.search(items):
            distinct, first = np.unique(lo, return_index=True)
            place, which = _ranges(distinct, hi[first])
            best[place], whose[place] = depth, suffix[first][which]  # depths only grow
            due = items.need[suffix] == depth
            if not due.any():
                continue
            suffix, (distinct, first, which) = suffix[due], np.unique(lo[due], return_index=True, return_inverse=True)
            # windows of equal item sets are of one class
            number = np.empty(len(distinct), np.int64)
            pairs = np.unique(which * len(items.names) + items.item[suffix])
            for k, own in enumerate(np.split(pairs % len(items.names), np.searchsorted(pairs, np.arange(1, len(distinct)) * len(items.names)))):
                number[k] = classes.setdefault(own.tobytes(), len(classes))
            place, which = _ranges(distinct, hi[due][first])
            place = shard.order[place]
            self.change += np.bincount(shard.word[place], minlength=len(self.change)) - np.bincount(shard.word[place] + depth, minlength=len(self.change))
            found.append(np.unique(np.stack((shard.text[place], number[which])), axis=1))
        self._longest(best, whose, items)
        if found:
            self._names(np.unique(np.concatenate(found, axis=1), axis=1), [np.frombuffer(k, np.int64) for k in classes], items.names)

    def _longest(self, best: np.ndarray, whose: np.ndarray, items: Items) -> None:
        """Of each text the longest match and its first place; of equal ones, that of the first item suffix."""
        word = self.shard.word[self.shard.order]
        by_word, of = np.zeros(len(self.words.hash), np.int32), np.zeros(len(self.words.hash), np.int32)
        by_word[word[word >= 0]], of[word[word >= 0]] = best[word >= 0], whose[word >= 0]
        begin, some = self.words.first[:-1], np.flatnonzero(self.words.counts)
        most = np.zeros(self.n, np.int64)
        most[some] = np.maximum.reduceat(by_word, begin[some])
        for t in np.flatnonzero(most > self.longest):
            at = int(np.argmax(by_word[begin[t] : self.words.first[t + 1]]))
            self.longest[t], self.at[t], self.item[t] = most[t], at, items.names[items.item[of[begin[t] + at]]]

    def _names(self, found: np.ndarray, members: list, names: list) -> None:
        known: dict[tuple, tuple] = {}
        texts, begin = np.unique(found[0], return_index=True)
        for t, own in zip(texts, np.split(found[1], begin[1:])):
            key = tuple(own)
            if key not in known:
                known[key] = tuple(names[i] for i in np.unique(np.concatenate([members[k] for k in own])))
            self.names[t] = tuple(sorted({*self.names[t], *known[key]})) if self.names[t] else known[key]

    @property
    def hits(self) -> np.ndarray:
        """Words inside a window, by text."""
        total = np.concatenate(([0], np.cumsum(np.cumsum(self.change[:-1]) > 0)))
        return total[self.words.first[1:]] - total[self.words.first[:-1]]

    def columns(self) -> dict:
        return {
            "n_words": pa.array(self.words.counts, pa.int64()), "n_hit": pa.array(self.hits, pa.int64()), "items": pa.array(self.names, pa.list_(pa.string())),
            "longest_match": pa.array(self.longest), "longest_item": pa.array(self.item, pa.string()), "longest_at": pa.array(self.at, pa.int64(), mask=self.longest == 0),
        }


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded text, or one longer item; the driver holds one partition and one block."""
    names, texts, size = [], [], 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull()).toLocalIterator():
        raw = (text or "").encode()
        if names and size + len(raw) > BLOCK_BYTES:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(name)
        texts.append(raw)
        size += len(raw)
    if names:
        yield names, texts


def _broadcast(df: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> list:
    sc = df.sparkSession.sparkContext
    return [sc.broadcast(Items.of(n, t, window)) for n, t in item_blocks(benchmark, item_col, item_text_col)]


def _overlap(texts: list, blocks: list) -> Overlap:
    out = Overlap(texts)
    for b in blocks:
        out.add(b.value)
        if len(blocks) > 1:
            vars(b).pop("_value", None)  # read from its file again for the next shard
    return out


SCHEMA = "n_words long, n_hit long, items array<string>, longest_match long, longest_item string, longest_at long"


def benchmark_overlap(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Words of each document inside an occurrence of a window of an item, and the longest match.

    Words: ASCII letters and digits and everything outside ASCII, A-Z lower-cased. A window:
    so many consecutive words of an item, or all of a shorter one. longest_match counts the
    words of the longest verbatim match with any item, longest_item and longest_at (word
    number) say where: of equal matches the first place and, in a block, the least item id
    as a string. Every suffix of every item is searched, so a match may be shorter than a window.
    Items without words or with a null id never match; items of one id are one; a null
    document text has no words. A text of any length is searched whole, in memory in
    proportion to it. Null or repeated ids give a row each; an empty table gives no rows, an
    empty benchmark no hits; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _broadcast(df, benchmark, item_col, item_text_col, window)

    def run(batches):
        for batch, texts in text_chunks(batches, "text", SHARD_BYTES):
            found = _overlap(texts, blocks)
            out = pa.RecordBatch.from_pydict({"id": batch.column(0)} | found.columns())
            for a, b in pieces_of(texts, map(len, found.names), BATCH_NAMES):
                yield out.slice(a, b - a)

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents without any benchmark window, all columns as they were.

    Nulls, empty and long texts, repeated rows and empty tables as in benchmark_overlap: a
    document without words is kept, and so is every one if the benchmark is empty.
    """
    blocks, names = _broadcast(df, benchmark, item_col, item_text_col, window), df.columns

    def run(batches):
        for batch, texts in text_chunks(batches, text_col, SHARD_BYTES):
            yield with_columns(batch, names, {}).filter(pa.array(_overlap(texts, blocks).hits == 0))

    return map_texts(df, run, df.schema)
