"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(store: Scratch, edges: DataFrame) -> DataFrame:
    """(c, root) of every node of edges (a, b); root is one node of its component.

    Each round points every node at its smallest neighbour, follows the pointers four
    steps far, and contracts; edges inside a component vanish. A star is gone after two
    rounds, a path shrinks by a factor in each. Each round is a written table.
    """
    edges = store.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots, k = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("root"))
        up = store.table(up, f"cc-up{k}")
        for j in range(2):
            nxt = up.select(F.col("c").alias("root"), F.col("root").alias("far"))
            up = store.table(up.join(nxt, "root").select("c", F.col("far").alias("root")), f"cc-up{k}-{j}")
            store.drop(f"cc-up{k}-{j - 1}" if j else f"cc-up{k}")
        if roots is None:
            roots = up
        else:
            further = up.select(F.col("c").alias("root"), F.col("root").alias("far"))
            roots = store.table(roots.join(further, "root", "left").select("c", F.coalesce("far", "root").alias("root")), f"cc-roots{k}")
        pa, pb = up.select(F.col("c").alias("a"), F.col("root").alias("ra")), up.select(F.col("c").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(pa, "a").join(pb, "b").where("ra <> rb")
        k += 1
        edges = store.table(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"cc-edges{k}")
        store.drop(f"cc-edges{k - 1}" if k > 1 else "cc-edges", f"cc-roots{k - 2}")
    if roots is None:
        return edges.select(F.col("a").alias("c"), F.col("b").alias("root"))
    return roots
