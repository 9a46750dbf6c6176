"""Connected components of a graph whose edges live in a table.

Alternating large-star and small-star steps over distinct edges: each step
points the neighbours of a node at the smallest of them, by a join with a
grouped minimum, so a node with many neighbours is never gathered anywhere.
Every round is written to the shared folder, which cuts the lineage; the rounds
end when a round changes no edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


_SIGN = -(1 << 63)


def node_of(doc_id: Column, key: Column) -> Column:
    """A node (binary) that sorts by the id, nulls last, and then by the key: the
    smallest node of a component then names it."""
    last = F.coalesce(doc_id, F.lit((1 << 63) - 1))
    return F.concat(F.unhex(F.lpad(F.hex(last.bitwiseXOR(F.lit(_SIGN))), 16, "0")), key)


def id_of(node: Column) -> Column:
    """The id in a node of ``node_of``."""
    raw = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.nullif(raw, F.lit((1 << 63) - 1))


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges``: (a, b) with b < a, distinct."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    # written down, so that the join reads both its sides through a shuffle of
    # their own and can split a node that has very many neighbours
    least = staged(least.select("a", F.least("a", "least").alias("least")), "components_least")
    linked = both.join(least, "a")
    if large:  # neighbours larger than the node point at the least of them all
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:  # smaller neighbours and the node itself point at the least
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return out.where("b < a").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge that isn't the root itself; ``root``
    is the smallest node of its component. ``edges``: (a, b) in any order."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    for _ in range(rounds):
        edges = staged(_step(_step(edges, large=True), large=False), "components")
        # a star forest is left unchanged: its edges are all (node, least)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def forest(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over ``link`` (left x
    right, both index arrays into the nodes; links hold both ways)."""
    label = np.arange(n)
    while True:
        now = label.copy()
        np.minimum.at(now, left, np.where(link, now[right][None, :], n).min(axis=1, initial=n))
        np.minimum.at(now, right, np.where(link, now[left][:, None], n).min(axis=0, initial=n))
        now = now[now]
        if (now == label).all():
            return label
        label = now
