"""Similarity join on word shingles with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold. All shingles have one global order, rare first, by a frequency estimate
over the whole corpus. If two sets share as much as the threshold asks for, then for
each l the prefixes of |r| - ceil(t |r|) + l shingles share l of them at least. Each
document chooses its own l by the estimated cost of its candidates; a pair must share
min(l, l') shingles of the prefixes before its full sets are compared.

Plan, with every step linear in the documents:

1. one scan: set size, a 64-bit class key of the set, and a counting sketch;
2. one scan: prefix shingles, grouped by shingle in NumPy. Classes that share one go
   to the star of its smallest class. A shingle that a chunk sees often is
   pre-aggregated there: one class enters the list for all, the others follow it to
   its star by a join;
3. one scan: the sets of classes in stars (a Bloom filter keeps the rest at home);
4. each star, or pair of bounded blocks of it, finds and verifies its pairs in memory
   and returns a spanning forest of its links, never the pairs;
5. connected components of those edges by contraction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .batches import map_texts, text_chunks, utf8
from .components import components
from .store import Scratch
from .words import FOLD, SPACED, Words, shingle_sets

#: Counters of the frequency sketch, 2 bytes each once summed; a fixed size for any corpus.
SKETCH_BITS = 23
_PIECE = 1 << 16  # counters in a row of the sketch
#: A shingle that one chunk of so many bytes sees in so many documents is aggregated there.
SCAN_BYTES, LOCAL_HOT = 4 << 20, 8
#: Copies of a piece of the sketch that one task adds up.
FAN_IN = 64
#: Prefix entries that one task groups, and shingles in one block of a star.
ENTRIES_A_TASK, BLOCK_SHINGLES = 2_000_000, 4_000_000
MAX_MATCHES = 24
#: Each set asks for a match in so many shingles at least; longer prefixes are cheap, fetched sets are not.
MATCH_EVERY = 16
#: Sizes are known to the tasks that group entries as whole powers of 1.1.
SIZE_STEP = 1.1


def class_key(s: np.ndarray) -> int:
    """64 bits of a set; two of n sets collide with a chance of n^2 / 2^65."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64))


class Prefixes:
    """The global order, and how long a prefix each set takes."""

    def __init__(self, sketch: np.ndarray, percent: int):
        middle = int(np.median(sketch))
        shift = max(0, middle.bit_length() - 13)
        self.rank = np.minimum(sketch >> shift, 65535).astype(np.uint16)
        self.floor, self.shift = middle >> shift, shift
        self.percent = percent

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix of a sorted set, and the number of matches that it asks for."""
        n = len(s)
        least = -(-self.percent * n // 100)
        seen = self.rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        order = np.lexsort((s, seen))
        low = max(1, n // MATCH_EVERY)
        top = max(low, min(MAX_MATCHES, least))
        base = n - least
        load = np.cumsum(np.maximum(seen[order[: base + top]].astype(np.int64) - self.floor, 0) << self.shift)
        l = np.arange(1, top + 1)  # noqa: E741
        cost = (base + l) + (1 + n / 16) * load[base : base + top] / l
        best = int(np.argmin(cost[low - 1 :])) + low
        return s[order[: base + best]], best


def _scan(batches, text, size):
    for batch, texts in text_chunks(batches, text, SCAN_BYTES):
        yield batch, shingle_sets(Words(utf8(texts), SPACED, FOLD), size)


def _classes(id_, id_type, text, size):
    def run(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch, sets in _scan(batches, text, size):
            every = np.concatenate([*sets, np.empty(0, np.uint64)])
            np.add.at(counters, (every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n = len(sets)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(batch.schema.get_field_index(id_)),
                "h": batch.column(batch.schema.get_field_index("h")),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "c": pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                "piece": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary()),
            })
        parts = counters.reshape(-1, _PIECE)
        k = len(parts)
        yield pa.RecordBatch.from_pydict({
            "id": pa.nulls(k, id_type), "h": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "c": pa.nulls(k, pa.int64()),
            "piece": pa.array(range(k), pa.int32()), "counts": pa.array([_packed(x) for x in parts], pa.binary()),
        })

    return run


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def _unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(v), "<u4")


def _add_pieces(batches):
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            totals[k] = totals.get(k, 0) + _unpacked(v).astype(np.int64)
    largest = np.iinfo(np.uint32).max
    yield pa.RecordBatch.from_pydict({"piece": pa.array(list(totals), pa.int32()), "counts": pa.array([_packed(np.minimum(v, largest)) for v in totals.values()], pa.binary()), "total": pa.array([int(v.sum()) for v in totals.values()], pa.int64())})


def _read_sketch(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A fixed number of counters, whatever the corpus, and their sum; added up in a tree."""
    pieces = rows.where("piece IS NOT NULL").select("piece", "counts", F.monotonically_increasing_id().alias("at"))
    copies = pieces.where("piece = 0").count()
    while copies > FAN_IN:
        copies = -(-copies // FAN_IN)
        group = F.pmod(F.xxhash64("at"), F.lit(copies))
        pieces = pieces.repartition("piece", group).mapInArrow(_add_pieces, "piece int, counts binary, total long").select("piece", "counts", F.monotonically_increasing_id().alias("at"))
    summed = pieces.select("piece", "counts").repartition("piece").mapInArrow(_add_pieces, "piece int, counts binary, total long")
    out, total = np.zeros(1 << SKETCH_BITS, np.uint32), 0
    for r in summed.toLocalIterator():
        out[r.piece * _PIECE : (r.piece + 1) * _PIECE] = _unpacked(r.counts)
        total += r.total
    return out, total


_POSTED = pa.schema([("p", pa.int32()), ("blob", pa.binary()), ("via", pa.int64()), ("c", pa.int64()), ("k", pa.int64())])


def _post(text, size, prefixes, parts):
    """Prefix entries by part; and of locally hot shingles, how many each class c shares with the class that it enters via."""
    pre = prefixes

    def run(batches):
        seen: set[int] = set()  # classes of this task that are done
        for _, sets in _scan(batches, text, size):
            tokens, owners, sizes = [], [], []
            for s in sets:
                if not len(s) or (c := class_key(s)) in seen:
                    continue
                seen.add(c)
                t, _ = pre.value(s)
                tokens.append(t)
                owners.append(np.full(len(t), c, np.int64))
                sizes.append(np.full(len(t), int(math.log(len(s), SIZE_STEP)), np.uint8))
            if not tokens:
                continue
            t, c, z = np.concatenate(tokens).view(np.int64), np.concatenate(owners), np.concatenate(sizes)
            order = np.lexsort((c, t))
            t, c, z = t[order], c[order], z[order]
            begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            many = np.diff(np.concatenate((begin, [len(t)])))
            hot = np.repeat(many >= LOCAL_HOT, many)
            lead = np.zeros(len(t), bool)
            lead[begin] = True
            member = hot & ~lead
            if member.any():
                via = np.repeat(c[begin], many)[member]
                pairs, k = np.unique(np.stack((via, c[member])), axis=1, return_counts=True)
                part = ((pairs[1].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(k), pa.binary()), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(k, pa.int64())], schema=_POSTED)
            t, c, z, hot = t[~member], c[~member], z[~member], hot[~member]
            part = (t.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            t, c, z, hot, part = t[order], c[order], z[order], hot[order], part[order]
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = [*begin[1:], len(part)]
            blobs = [t[a:b].tobytes() + c[a:b].tobytes() + z[a:b].tobytes() + hot[a:b].tobytes() for a, b in zip(begin, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(blobs, pa.binary()), *(pa.nulls(len(blobs), pa.int64()) for _ in range(3))], schema=_POSTED)

    return run


_STARS = pa.schema([("q", pa.int32()), ("blob", pa.binary()), ("kind", pa.string()), ("via", pa.int64()), ("lead", pa.int64()), ("c", pa.int64()), ("k", pa.int64())])
_STAR_COLUMNS = "q int, blob binary, kind string, via long, lead long, c long, k long"


def _star_rows(kind, q, via, lead, c, k):
    size = len(k)
    longs = (pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (via, lead, c, k))
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.nulls(size, pa.binary()), pa.array([kind] * size, pa.string()), *longs], schema=_STARS)


def _stars(parts):
    """Of one part: entries (star, class, shared shingles k) in blobs by star; stars 'h' of entering classes; and 'm' as they came."""

    def rows(kind, via, lead, c, k):
        spread = via if lead is None or kind == "h" else lead
        return _star_rows(kind, _dealt(np.asarray(spread), parts), via, lead, c, k)

    return lambda batches: _stars_of(batches, rows, parts)


def _dealt(c: np.ndarray, parts: int) -> np.ndarray:
    return ((c.astype(np.int64).view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def _merge_stars(batches):
    """Entries of the same star and class from all parts, added up; other rows pass."""
    found = []
    for b in batches:
        other = b.filter(b.column(1).is_null())
        if other.num_rows:
            yield other
        found += [np.frombuffer(v, np.int64).reshape(3, -1) for v in b.column(1).drop_null().to_pylist()]
    if found:
        lead, c, k = np.concatenate(found, axis=1)
        pairs, which = np.unique(np.stack((lead, c)), axis=1, return_inverse=True)
        total = np.bincount(which.ravel(), weights=k, minlength=pairs.shape[1]).astype(np.int64)
        yield _star_rows("s", np.zeros(len(total), np.int32), None, pairs[0], pairs[1], total)


def _stars_of(batches, rows, parts_):
    parts = []
    for b in batches:
        own = b.column(1).is_null()
        m = b.filter(own)
        if m.num_rows:
            yield rows("m", m.column(2), None, m.column(3), m.column(4))
        for v in b.column(1).drop_null().to_pylist():
            k = len(v) // 18
            parts.append((np.frombuffer(v, np.int64, k), np.frombuffer(v, np.int64, k, 8 * k), np.frombuffer(v, np.uint8, k, 16 * k), np.frombuffer(v, bool, k, 17 * k)))
    if not parts:
        return
    t, c, z, hot = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((c, z, t))
    t, c, z, hot = t[order], c[order], z[order], hot[order]
    new = np.concatenate(([True], t[1:] != t[:-1]))
    begin = np.flatnonzero(new)
    flagged = np.logical_or.reduceat(hot, begin)
    # sizes too far apart to link part a list, unless members of it are elsewhere
    apart = np.concatenate(([False], z[1:].astype(int) - z[:-1] > 3)) & ~np.repeat(flagged, np.diff(np.concatenate((begin, [len(t)]))))
    run = np.flatnonzero(new | apart)
    many = np.diff(np.concatenate((run, [len(t)])))
    lead = np.repeat(np.minimum.reduceat(c, run), many)
    pairs, k = np.unique(np.stack((c[hot], lead[hot])), axis=1, return_counts=True)
    yield rows("h", pairs[0], pairs[1], None, k)
    shared = np.repeat(many > 1, many) | np.repeat(flagged, np.diff(np.concatenate((begin, [len(t)]))))
    # a class stands once in a list; tasks that saw copies of it repeat the entry
    shared &= np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
    pairs, k = np.unique(np.stack((lead[shared], c[shared])), axis=1, return_counts=True)
    q = _dealt(pairs[0], parts_)
    order = np.argsort(q, kind="stable")
    q, entries = q[order], np.vstack((pairs, k))[:, order]
    begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    blobs = [np.ascontiguousarray(entries[:, a:b]).tobytes() for a, b in zip(begin, [*begin[1:], len(q)])] if len(q) else []
    none = pa.nulls(len(blobs), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(q[begin] if blobs else [], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.string()), none, none, none, none], schema=_STARS)


def _bloom(ids: DataFrame, n: int) -> np.ndarray:
    """One bit a hash; its size follows the candidates up to 64 MB, beyond that it only lets more through."""
    bits = 1 << max(16, min(29, (16 * n).bit_length()))
    words = ids.select(F.pmod("h", F.lit(bits)).alias("b")).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, int(b % 64)) AS m"))
    out = np.zeros(bits >> 6, np.int64)
    got = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out


def _sets(text, size, bloom):
    def run(batches):
        bits = bloom.value
        seen: set[int] = set()
        mask = (len(bits) << 6) - 1

        def wanted():
            for b in batches:
                h = b.column(b.schema.get_field_index("h")).to_numpy() & mask
                yield b.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))

        for b, sets in _scan(wanted(), text, size):
            rows, keys = b.column(b.schema.get_field_index("h")), [class_key(s) for s in sets]
            new = [i for i, x in enumerate(zip(rows.to_pylist(), keys)) if not (x in seen or seen.add(x))]  # a row may be repeated
            yield pa.RecordBatch.from_pydict({"h": rows.take(pa.array(new, pa.int64())), "c": pa.array([keys[i] for i in new], pa.int64()), "tokens": pa.array([sets[i].tobytes() for i in new], pa.binary())})

    return run


class _Forest:
    """Sets that are known to be linked, directly or not."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, a):
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a, b) -> bool:
        """Whether they were apart."""
        x, y = self.root(a), self.root(b)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _ranges(lo, hi):
    many = hi - lo
    return np.arange(many.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many)


def links_of(sets: list, side: np.ndarray, prefixes: Prefixes, percent: int):
    """A spanning forest of the links among the sets; with two sides, among those between them.

    side: 0 or 1, or 2 where both hold (pairs inside the block count too). Neighbours in the
    lists of prefix shingles are compared first, which joins copies to trees. Then each set
    is compared with all sets of other trees that share enough of its prefix; nothing is
    looked at inside a tree, so a large group of copies is not paired up.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    pre = [prefixes(s) for s in sets]
    need = np.array([x[1] for x in pre])
    forest = _Forest(n)
    owner, token = np.repeat(np.arange(n), [len(x[0]) for x in pre]), np.concatenate([x[0] for x in pre])
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    may = lambda a, b: (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])) & ((side[a] != side[b]) | (side[a] == 2))

    beside = np.flatnonzero(token[1:] == token[:-1])
    pairs, shared = np.unique(owner[beside] * n + owner[beside + 1], return_counts=True)
    a, b = pairs // n, pairs % n
    likely = np.flatnonzero(may(a, b) & (2 * shared >= np.minimum(need[a], need[b])))
    for k in likely[np.argsort(-shared[likely], kind="stable")]:
        x, y = int(a[k]), int(b[k])
        if forest.root(x) != forest.root(y) and _similar(sets[x], sets[y], percent):
            forest.join(x, y)
            yield x, y

    tree = np.array([forest.root(x) for x in range(n)])[owner]
    order = np.lexsort((owner, tree, token))
    owner, token, tree = owner[order], token[order], tree[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    fresh = new | np.concatenate(([True], tree[1:] != tree[:-1]))
    bounds = lambda first: (np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)), np.append(np.flatnonzero(first), len(first))[np.cumsum(first)])
    (begin, end), (own_begin, own_end) = bounds(new), bounds(fresh)
    mixed = np.flatnonzero((begin < own_begin) | (own_end < end))  # entries with another tree in their list
    mixed = mixed[np.argsort(owner[mixed], kind="stable")]
    if not len(mixed):
        return
    for at in np.split(mixed, np.flatnonzero(owner[mixed][1:] != owner[mixed][:-1]) + 1):
        x = int(owner[at[0]])
        others = owner[np.concatenate((_ranges(begin[at], own_begin[at]), _ranges(own_end[at], end[at])))]
        found, shared = np.unique(others[others > x], return_counts=True)
        found = found[(shared >= np.minimum(need[found], need[x])) & may(found, x)]
        for y in map(int, found):
            if forest.root(x) != forest.root(y) and _similar(sets[x], sets[y], percent):
                forest.join(x, y)
                yield x, y


def _similar(x, y, percent):
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(prefixes, percent):
    """Rows of a partition stand sorted by star and blocks; only one group is held at a time."""

    def run(batches):
        pre = prefixes.value
        key, cs, sets, sides = None, [], [], []
        out: list[tuple[int, int]] = []

        def close():
            if len(cs) > 1:
                order = np.argsort(cs)
                c = np.array(cs)[order]
                out.extend((int(c[a]), int(c[b])) for a, b in links_of([sets[i] for i in order], np.array(sides)[order], pre, percent))

        def flush():
            rows = pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
            out.clear()
            return rows

        for batch in batches:
            for lead, i, j, side, c, tokens in zip(*(x.to_pylist() for x in batch.columns)):
                if (lead, i, j) != key:
                    close()
                    key, cs, sets, sides = (lead, i, j), [], [], []
                if cs and cs[-1] == c:  # rows without an id may be repeated
                    continue
                cs.append(c)
                sets.append(np.frombuffer(tokens, np.uint64))
                sides.append(side)
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    return run


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Shingle-set sizes and similarity components of all documents.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the
    distinct shingles of so many words, or the whole shorter sequence. Returns
    (id_col, n_shingles, component_id): the smallest id that links reach, itself included.

    A null or wordless text has an empty set (0 shingles), links with nothing and is its
    own component. A row with a null id links like others but never names a component; one
    of rows without ids alone is null. Repeated ids give a row each; a tie in similarity (just
    the threshold) links. A text of any length is read whole, in memory in proportion to it.
    Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    store = Scratch(spark, "jaccard")
    id_, text = F.col(id_col), F.col(text_col).cast("string")
    # h: the key by which a row is fetched again
    docs = df.select(id_.alias("id"), text.alias("text"), F.when(id_.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(id_)).alias("h"))
    id_type = docs.schema["id"].dataType.simpleString()
    rows = store.table(map_texts(docs, _classes("id", to_arrow_type(docs.schema["id"].dataType), "text", words), f"id {id_type}, h long, n long, c long, piece int, counts binary"), "classes")
    slim = rows.where("piece IS NULL").select("id", "h", "n", "c")
    edges = _edges(spark, sc, store, docs, rows, slim, words, percent)
    return _assemble(store, slim, edges, id_col)


def _edges(spark: SparkSession, sc, store, docs, rows, slim, words, percent) -> DataFrame:
    sketch, total = _read_sketch(rows)
    prefixes = sc.broadcast(Prefixes(sketch, percent))
    entries = total * (100 - percent) // 100
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // ENTRIES_A_TASK)
    posted = map_texts(docs.select("text"), _post("text", words, prefixes, parts), "p int, blob binary, via long, c long, k long")
    entries_by_star = posted.repartition(parts, "p").mapInArrow(_stars(parts), _STAR_COLUMNS)
    starred = store.table(entries_by_star.repartition(parts, "q").mapInArrow(_merge_stars, _STAR_COLUMNS).select("kind", "via", "lead", "c", "k"), "stars")
    # k is a bound where a class came via another one: of its shingles, or of the other's
    hot = starred.where("kind = 'h'").groupBy("via", "lead").agg(F.sum("k").alias("kh"))
    members = starred.where("kind = 'm'").select("via", "c", "k").join(hot, "via").select("lead", "c", F.least("k", "kh").alias("k"))
    held = starred.where("kind = 's'").select("lead", "c", "k").union(members).groupBy("lead", "c").agg(F.sum("k").alias("k"))
    classes = slim.where("c IS NOT NULL").groupBy("c").agg(F.min("h").alias("h"), F.min("n").alias("n"))
    # A pair shares m shingles at least, in stars that both are in. If either leaves its
    # stars of fewest shingles, up to (m - 1) / 2 of them, one that holds both remains.
    m = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / MATCH_EVERY))
    rising = Window.partitionBy("c").orderBy("k", "lead").rowsBetween(Window.unboundedPreceding, 0)
    held = held.join(classes, "c").withColumn("upto", F.sum("k").over(rising)).where(F.col("upto") > F.floor((m - 1) / 2))
    held = store.table(held.select("lead", "c", "h", "n"), "held")
    store.drop("stars")
    weight = held.groupBy("lead").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("int").alias("k"), F.count(F.lit(1)).alias("members")).where("members > 1")
    star = store.table(held.join(weight, "lead").select("lead", "c", "h", "k"), "star")
    wanted = star.select("h").distinct()
    n = wanted.count()
    bloom = sc.broadcast(_bloom(wanted, n))
    sets = map_texts(docs.select("h", "text"), _sets("text", words, bloom), "h long, c long, tokens binary")
    placed = star.withColumn("own", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    blocks = placed.select("lead", "c", "h", "own", other.alias("o")).select(
        "lead", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"),
        F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1).alias("side"), "c", "h",
    )
    # the pairs inside a block are found where i = j; elsewhere only those between two blocks
    work = blocks.join(sets, ["c", "h"]).select("lead", "i", "j", "side", "c", "tokens").repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "c")
    edges = store.table(work.mapInArrow(_verify(prefixes, percent), "a long, b long"), "edges")
    store.drop("held", "star")
    return edges


def _assemble(store: Scratch, slim: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    roots = components(store, edges)
    classes = slim.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("least"))
    linked = roots.join(classes, "c")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("c", "component")
    # a written table: the last join then has nothing but joins in its stage, and a class of very many copies can be split
    known = store.table(classes.join(linked, "c", "left").select("c", F.coalesce("component", "least").alias("component")), "known")
    return slim.join(known, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
