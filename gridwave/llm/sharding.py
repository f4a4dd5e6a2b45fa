"""K-d tree shards: cells of metadata space with equal bytes.

Documents are summed into units, one for each different text, which always stay whole.
Cells are split at weighted medians along their widest dimension until every leaf has its
share of the bytes. A median is found by histogram descent over order-preserving 52-bit
keys: each round counts the bytes of a bounded number of bins and keeps the bin that holds
the median, so the driver sees a bounded number of counts and never all units.

A unit too large for a histogram to balance (over a thousandth of its cell) is placed
first: one that fills a leaf gets it for itself, those over an eighth of a leaf are dealt
evenly, the others are split at their own weighted median along the same dimension, and
the cut through all smaller units makes up for what that leaves uneven.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import with_rank
from .store import Scratch

#: Bits of a dimension's key and of its tie-break.
VALUE_BITS, TIE_BITS = 20, 32
KEY_BITS = VALUE_BITS + TIE_BITS
#: Bins of all open cells that a round counts at most, and the most bits of one cell.
BINS, BIN_BITS = 1 << 20, 13
#: A unit over this share of its cell is placed by itself; over all open cells so many at most.
LARGE_SHARE, LARGE_UNITS = 1 / 1024, 100_000
#: A text in over this share of the rows is joined to its copies without a shuffle; there are fewer than 1 / share.
COMMON_SHARE = 1 / 20_000


def default_dimensions(df: DataFrame) -> dict[str, Column]:
    """Numeric dimensions from the metadata that the table has; nulls stand at -1."""
    known = {
        "n_chars": lambda c: F.log2(F.greatest(F.col(c).cast("double"), F.lit(0.0)) + 1),
        "lang": lambda c: F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")).cast("double"),
        "source": lambda c: F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")).cast("double"),
    }
    return {c: F.coalesce(f(c), F.lit(-1.0)) for c, f in known.items() if c in df.columns}


class Scale:
    """Places along each dimension: VALUE_BITS of its value between its bounds, then the unit's tie-break."""

    def __init__(self, lows: dict, highs: dict):
        self.low, self.span = lows, {d: highs[d] - lows[d] for d in lows}
        self.top = float((1 << VALUE_BITS) - 1)

    def key(self, dim: str, value: float, tie: int) -> int:
        scaled = math.floor((value - self.low[dim]) / self.span[dim] * self.top) if self.span[dim] > 0 else 0
        return (scaled << TIE_BITS) + tie

    def column(self) -> Column:
        """The same for the dimension named in `dim`."""
        value = F.lit(0).cast("long")
        for d, span in self.span.items():
            if span > 0:
                value = F.when(F.col("dim") == d, F.floor((F.col(d) - self.low[d]) / span * self.top).cast("long")).otherwise(value)
        return F.shiftleft(value, TIE_BITS) + F.col("tie")


@dataclass
class Cell:
    """An open cell: its leaves, place in the tree, bytes, and how it is split."""

    leaves: int
    path: tuple
    bytes: int
    limit: int = 0  # larger units are placed one by one
    dim: str = ""
    want: int = 0  # bytes of smaller units on the left
    cut: int = 0
    left: int = 0  # bytes of smaller units that the cut gives
    side: int = 0  # the cell on the left; the one on the right has the next number


def _large(total: int, cells: int) -> int:
    return int(total * max(LARGE_SHARE, cells / LARGE_UNITS))


def place_large(units: list[tuple[int, int]], total: int, leaves: int) -> tuple[list[int], list[int], list[int]]:
    """Numbers of the large units (key, bytes) of a cell that get leaves of their own, go left, and go right."""
    alone: list[int] = []
    for i in sorted(range(len(units)), key=lambda i: (-units[i][1], units[i][0])):
        if leaves - len(alone) < 2 or units[i][1] * (leaves - len(alone)) < total:
            break
        alone.append(i)
        total -= units[i][1]
    k = leaves - len(alone)
    if k < 2:
        return alone, [], []
    rest = [i for i in range(len(units)) if i not in set(alone)]
    bins: list[list[int]] = [[] for _ in range(k)]  # units over an eighth of a leaf, dealt to the leaves
    for i in sorted(rest, key=lambda i: (-units[i][1], units[i][0])):
        if units[i][1] * 8 * k > total:
            min(bins, key=lambda b: sum(units[j][1] for j in b)).append(i)
    middle = lambda b: sum(units[i][0] * units[i][1] for i in b) / max(1, sum(units[i][1] for i in b))
    bins.sort(key=lambda b: (not b, middle(b)))
    bins = bins[::2] + bins[1::2] if any(not b for b in bins) else bins  # empty ones on both sides
    left, right = sum(bins[: k // 2], []), sum(bins[k // 2 :], [])
    rest = sorted(set(rest) - set(left) - set(right), key=lambda i: units[i][0])
    heavy, want = sum(units[i][1] for i in rest), total * (k // 2) // k - sum(units[i][1] for i in left)
    room = total - want - sum(units[i][1] for i in left + right)  # on the right
    best, upto = None, 0
    for p in range(len(rest) + 1):
        # bytes that no smaller unit can make up for; then the shares of both sides
        by = max(0, upto - want) + max(0, heavy - upto - room), abs(upto * max(room, 1) - (heavy - upto) * max(want, 1))
        best = min(best or (by, p), (by, p))
        upto += units[rest[p]][1] if p < len(rest) else 0
    return alone, left + rest[: best[1]], right + rest[best[1] :]


def _cuts(units: DataFrame, scale: Scale, cells: dict[int, Cell]) -> None:
    """Sets cut and left of each cell: the first key on the right that gives about the bytes wanted on the left."""
    open_ = {}
    for c, cell in cells.items():
        if cell.want <= 0:
            cell.cut, cell.left = 0, 0
        else:
            open_[c] = [0, 1 << KEY_BITS, 0]  # keys that are still open, bytes left of them
    bits = KEY_BITS
    while open_:
        bits = max(0, bits - max(1, min(BIN_BITS, int(math.log2(BINS / len(open_))))))
        ask = F.broadcast(units.sparkSession.createDataFrame([(c, cells[c].dim, cells[c].limit, low, high) for c, (low, high, _) in open_.items()], "cell long, dim string, cell_limit long, low long, high long"))
        keyed = units.join(ask, "cell").where("bytes <= cell_limit").withColumn("key", scale.column()).where("key >= low AND key < high")
        by: dict[int, list] = {}
        for r in keyed.groupBy("cell", F.shiftright("key", bits).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect():
            by.setdefault(r.cell, []).append((r.bin, r.bytes))
        for c in list(open_):
            cell, (_, high, total) = cells[c], open_[c]
            cut, left = high, total  # all smaller units are on the left
            for b, w in sorted(by.get(c, [])):
                if total + w < cell.want:
                    total += w
                    cut, left = (b + 1) << bits, total
                    continue
                short, over = cell.want - total, total + w - cell.want
                cut, left = ((b << bits, total) if short <= over else ((b + 1) << bits, total + w))
                if min(short, over) > cell.bytes // 4096 and bits:
                    cut, open_[c] = None, [b << bits, (b + 1) << bits, total]
                break
            if cut is not None:
                cell.cut, cell.left = cut, left
                del open_[c]


def kd_shards(df: DataFrame, target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", dimensions: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) per document.

    Size: UTF-8 bytes of the text (null: none) plus 1. Give target_bytes for leaves of about
    that size, or a number of shards of equal bytes. Equal texts are always in one shard; a
    text whose copies exceed a shard's bytes has a shard to itself, and the others share the
    rest evenly. Ties along a dimension go by a hash of the text. slot counts from 0 in each
    shard without gaps. Null and repeated ids are rows like others; null and empty texts are
    one group; a text of any length is a row of its size; an empty table gives no rows;
    columns besides the dimensions (default: n_chars, lang and source, where present) are
    ignored.
    """
    spark = df.sparkSession
    store = Scratch(spark, "sharding")
    dimensions = default_dimensions(df) if dimensions is None else dimensions
    dims = [f"d{i}" for i in range(len(dimensions))] or ["d0"]
    columns = list(dimensions.values()) or [F.lit(0.0)]
    text = F.col(text_col).cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    slim = df.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("hash"),
        *(F.coalesce(F.nanvl(c.cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias(d) for c, d in zip(columns, dims)), F.monotonically_increasing_id().alias("_row"),
    )
    slim = store.table(slim, "slim")
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        shards = max(1, -(-total // target_bytes)) if target_bytes else 1
    group = ["hash", "crc", "size"]
    units = slim.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *(F.min(d).alias(d) for d in dims))
    units = store.table(units.withColumn("tie", F.shiftrightunsigned(F.xxhash64("hash", "crc"), 64 - TIE_BITS)).withColumn("cell", F.lit(0).cast("long")), "units")
    bounds = units.agg(*(f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    scale = Scale({d: bounds[f"lo{d}"] or 0.0 for d in dims}, {d: bounds[f"hi{d}"] or 0.0 for d in dims})
    leaves: list[tuple[tuple, int]] = []  # paths and cells that are done
    cells, made, level = {0: Cell(int(shards), (), int(total))}, 1, 0
    while cells:
        leaves += [(cell.path, c) for c, cell in cells.items() if cell.leaves < 2]
        cells = {c: cell for c, cell in cells.items() if cell.leaves > 1}
        if not cells:
            break
        for cell in cells.values():
            cell.limit = _large(cell.bytes, len(cells))
        limits = spark.createDataFrame([(c, cell.limit) for c, cell in cells.items()], "cell long, cell_limit long")
        large = F.collect_list(F.when(F.col("bytes") > F.col("cell_limit"), F.struct(*group, "bytes", "tie", *dims))).alias("large")  # LARGE_UNITS over all cells at most
        stats = {r.cell: r for r in units.join(F.broadcast(limits), "cell").groupBy("cell").agg(large, *(f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        nxt, placed = {}, []
        for c, cell in cells.items():
            r, extent = stats.get(c), lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / (scale.span[d] or 1.0)  # noqa: B023
            cell.dim = max(dims, key=extent) if r else dims[0]
            own = sorted(r.large, key=lambda u: (u.hash, u.crc, u.size)) if r else []
            alone, left, right = place_large([(scale.key(cell.dim, u[cell.dim], u.tie), u.bytes) for u in own], cell.bytes, cell.leaves)
            for i in alone:
                placed.append((c, own[i].hash, own[i].crc, own[i].size, made))
                leaves.append(((*cell.path, 2, i), made))
                made += 1
            k, rest = cell.leaves - len(alone), cell.bytes - sum(own[i].bytes for i in alone)
            cell.side, made = made, made + 2
            for side, members in enumerate((left, right), cell.side):
                placed += [(c, own[i].hash, own[i].crc, own[i].size, side) for i in members]
            heavy = [sum(own[i].bytes for i in members) for members in (left, right)]
            light = rest - sum(heavy)
            cell.want = min(max(0, rest * (k // 2) // k - heavy[0]), light) if k > 1 else 0
            nxt[cell.side], nxt[cell.side + 1] = Cell(k // 2, (*cell.path, 0), heavy[0]), Cell(k - k // 2, (*cell.path, 1), rest - heavy[0])
        _cuts(units, scale, cells)
        for cell in cells.values():
            nxt[cell.side].bytes += cell.left
            nxt[cell.side + 1].bytes -= cell.left
        moves = spark.createDataFrame([(c, cell.dim, cell.cut, cell.side) for c, cell in cells.items()], "cell long, dim string, cut long, _left long")
        exact = spark.createDataFrame(placed, "cell long, hash long, crc long, size long, _to long")
        moved = units.join(F.broadcast(moves), "cell", "left").join(F.broadcast(exact), ["cell", *group], "left")
        side = F.col("_left") + (scale.column() >= F.col("cut")).cast("long")
        units = store.table(moved.withColumn("cell", F.coalesce("_to", side, "cell")).drop("dim", "cut", "_left", "_to"), f"units{level}")
        store.drop(f"units{level - 1}" if level else "units")
        cells, level = {c: cell for c, cell in nxt.items() if cell.leaves}, level + 1
    numbers = spark.createDataFrame([(c, i) for i, (_, c) in enumerate(sorted(leaves))], "cell long, shard int")
    placed = units.join(F.broadcast(numbers), "cell").select(*group, "rows", "shard")
    common = F.broadcast(placed.where(F.col("rows") > rows * COMMON_SHARE).select(*group, F.col("shard").alias("_shard")))  # 1 / COMMON_SHARE rows at most
    docs = slim.select("id", *group, "_row").join(common, group, "left")
    rare = docs.where("_shard IS NULL").join(placed.where(F.col("rows") <= rows * COMMON_SHARE).select(*group, "shard"), group)
    docs = docs.where("_shard IS NOT NULL").withColumn("shard", F.col("_shard")).select("id", "size", "crc", "shard", "_row").union(rare.select("id", "size", "crc", "shard", "_row"))
    docs = store.table(docs, "placed")
    docs = with_rank(docs, rows, "shard", ["id", "crc", "_row"], F.col("_row"), "slot")
    return docs.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
