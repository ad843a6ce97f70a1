"""Connected components over a table of links, by contraction and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.textkernel import released
from tessella.session import ship

#: Links that a task contracts by itself at a time.
HELD = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of some links, all of which fit in memory: the smallest node that each one reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the same nodes as those of the task, each to the smallest one that they reach there."""

    def solve(parts):
        node, root = least_reached(*(np.concatenate(c) for c in zip(*parts)))
        far = node != root
        return pa.RecordBatch.from_arrays([pa.array(root[far]), pa.array(node[far])], ["src", "dst"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        n += batch.num_rows
        if n >= HELD:
            yield solve(held)
            held, n = [], 0
    if held:
        yield solve(held)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst: long); root is the smallest node reachable.

    Each task first puts stars in place of its own links.  Then, in each round,
    every node takes its smallest neighbour, if smaller, as parent; parents
    jump to their parents' parents until each points to the top of its tree,
    which takes the logarithm of the longest chain; links move to the tops, and
    those within a node vanish.  A chain of any length thus costs one round.
    The rounds' parents are put together at the end.  The minima are sums with map-side combining, and
    each lookup joins two written tables, so that a hub's rows can be split.
    Self-links and nulls are left out; an empty table gives an empty one.
    """
    ship(edges.sparkSession)
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    links = materialize(links.mapInArrow(released(_stars), "src long, dst long").distinct(), name)
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = materialize(nodes, name)
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select("dst", "src"))
        parents = both.groupBy("src").agg(F.min("dst").alias("up")).where("up < src").select(F.col("src").alias("child"), "up")
        rounds.append(_tops(materialize(parents, name), name))
        step = lambda df, column: (
            df.join(rounds[-1], df[column] == rounds[-1]["child"], "left")
            .withColumn(column, F.coalesce("up", column))
            .drop("child", "up")
        )
        moved = step(step(links, "src"), "dst").where("src <> dst")
        links = materialize(moved.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), name)
    # the tops of one round may have parents in later ones
    tops = None
    for parents in reversed(rounds):
        if tops is None:
            tops = parents
            continue
        later = tops.select(F.col("child").alias("of"), F.col("up").alias("top"))
        risen = parents.join(later, parents["up"] == later["of"], "left").select("child", F.coalesce("top", "up").alias("up"))
        tops = materialize(risen.unionByName(tops), name)
    if tops is None:
        return nodes.select("node", F.col("node").alias("root"))
    return materialize(nodes.join(tops, nodes["node"] == tops["child"], "left").select("node", F.coalesce("up", "node").alias("root")), name)


def _tops(parents: DataFrame, name: str) -> DataFrame:
    """(child, up) with the top of each tree for ``up``: what has not got there jumps to its parent's parent, all at once."""
    active, done = parents, []
    while True:
        table = active
        for part in done:
            table = table.unionByName(part)
        higher = table.select(F.col("child").alias("of"), F.col("up").alias("higher"))
        jumped = materialize(active.join(higher, active["up"] == higher["of"], "left").select("child", "up", "higher"), name)
        done.append(jumped.where("higher is null").select("child", "up"))
        active = jumped.where("higher is not null").select("child", F.col("higher").alias("up"))
        if active.isEmpty():
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return materialize(out, name) if len(done) > 1 else out
