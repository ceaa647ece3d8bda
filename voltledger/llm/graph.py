"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: So many links are joined up by one task (16 bytes each, about ten times that while it works); more are contracted first.
TASK_LINKS = 1_000_000


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Per node (0 to n - 1) the smallest node that it is connected with by the links i, j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, to: every node of a bounded number of links, with the smallest one that it is connected with."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        to = nodes[forest(at[: len(a)], at[len(a) :], len(nodes))]
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + (1 << 16)]), pa.array(to[lo : lo + (1 << 16)])], ["node", "to"])


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60, task_links: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (columns a, b).

    While more than task_links links are left (TASK_LINKS if not given), a round maps each node to the first of itself and its
    neighbours, and replaces the links by those between the images; links inside an image vanish. In even rounds the smallest id is
    first, which takes in a star around its smallest node at once; in odd rounds the smallest hash, which shortens a chain by a constant
    share. So rounds grow with the logarithm of the longest chain. The links left are joined up in one task, whose size is that bound. The
    maps, each smaller than the one before, are then followed back. Every group is summed up map-side; nothing but a count comes to the driver."""
    bound = TASK_LINKS if task_links is None else task_links
    left = scratch.put(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while left.count() > bound:
        if len(maps) == max_rounds:
            raise RuntimeError("components did not settle")
        rank = lambda c: F.xxhash64(c, F.lit(len(maps))) if len(maps) % 2 else F.col(c)
        ranked = lambda c: F.struct(rank(c).alias("h"), F.col(c).alias("node"))
        ends = left.select("a", "b").union(left.select("b", "a"))
        first = ends.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        step = scratch.put(first.select(F.col("a").alias("node"), F.least("m", ranked("a"))["node"].alias("to")), "map")
        of = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        moved = left.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where("a2 != b2")
        left = scratch.put(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        maps.append(step)
    roots = left.coalesce(1).mapInArrow(joined_up, "node long, to long")
    if not maps:
        return scratch.put(roots.select("node", F.col("to").alias("component")), "roots")
    roots = scratch.put(roots, "map")
    for step in reversed(maps):
        ends = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        # a node without links after a round is its own root
        roots = step.join(ends.hint("merge"), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    roots = scratch.put(roots, "roots")
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return roots.join(least.hint("merge"), "to").select("node", "component")
