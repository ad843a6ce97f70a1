"""SimHash fingerprints, and near copies by a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, materialize
from tessella.llm.graph import components
from tessella.llm.jaccard import keyed_runs
from tessella.llm.textkernel import Words, majority, mapped, released, text_slices, xxh64
from tessella.session import ship

BITS = 64
#: Vantage points tried for each node; rows of a leaf, in which all are compared; rows of a shard, about.
TRIES = 8
LEAF = 192
SHARD = 4096
#: Shards at most, beyond which they grow; fingerprints that the upper levels of the tree are made from.
MOST_SHARDS = 1 << 16
MOST_SAMPLE = 1 << 20


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text over shingles of ``words`` words.

    A-Z count as a-z.  Repeated shingles vote each time.  A text with fewer
    words has one shingle, one without (or null) the fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for low, high, raw, offsets in text_slices(batch.column(1)):
                text = Words(raw, offsets)
                starts, lengths, index = text.shingles(words)
                out[low:high] = majority(xxh64(text.buffer, starts, lengths, seed), index)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return mapped(columns, run, "doc_id long, fp long")


@dataclass
class Tree:
    """The upper levels of a vantage-point tree, node k above nodes 2k + 1 (within the radius) and 2k + 2 (beyond it)."""

    depth: int
    points: np.ndarray
    radii: np.ndarray

    def shards(self, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): each fingerprint's own shard, and all others that it must be looked for in.

        By the triangle bound, of a pair within ``distance`` of one another the
        outer one lies within radius + distance of the vantage point if the
        inner one lies within the radius.  So a fingerprint beyond the radius
        by ``distance`` at most also goes into the inner branch; all others
        prune it.  At every node the copies of a pair thus have a branch in
        common, and at last a shard.
        """
        row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for _ in range(self.depth):
            beyond = np.bitwise_count(fp[row] ^ self.points[node]).astype(np.int64) - self.radii[node]
            edge = (beyond > 0) & (beyond <= distance)
            row, node = np.concatenate([row, row[edge]]), np.concatenate([2 * node + 1 + (beyond > 0), 2 * node[edge] + 1])
        return row, node - (1 << self.depth) + 1


def split(fp: np.ndarray, distance: int, tries: np.ndarray) -> tuple[np.uint64, int, int]:
    """(vantage point, radius, rows that the larger branch gets): of ``tries`` and radii about the middle, the one with the smallest larger branch."""
    best = (fp[0], BITS, 2 * len(fp))
    for point in tries:
        counts = np.cumsum(np.bincount(np.bitwise_count(fp ^ point), minlength=BITS + distance + 1))
        larger = np.maximum(counts[distance : BITS + distance + 1], len(fp) - counts[: BITS + 1])
        radius = int(larger.argmin())
        if larger[radius] < best[2]:
            best = (point, radius, int(larger[radius]))
    return best


def tree_of(sample: np.ndarray, depth: int, distance: int, seed: int = 0) -> Tree:
    """A tree of 2 ** ``depth`` shards, vantage points and radii out of a sample of the fingerprints."""
    rng = np.random.default_rng(seed)
    points, radii = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, BITS)
    parts = [sample]
    for node in range(len(points)):
        part, parts[node] = parts[node], None
        if len(part):
            points[node], radii[node], _ = split(part, distance, rng.choice(part, min(len(part), TRIES), replace=False))
        inside = np.bitwise_count(part ^ points[node]) <= radii[node]
        parts += [part[inside], part[~inside]]
    return Tree(depth, points, radii)


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever is within ``distance``, by search from each member in turn; as pairs of places."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= distance
            if near.any():
                hit = left[near]
                left = left[~near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                queue.extend(hit.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def shard_links(fp: np.ndarray, distance: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the distinct fingerprints of a shard hold within ``distance``, as pairs of places.

    The lower levels of the tree, down to leaves in which all are compared.  A
    branch that no vantage point makes much smaller, as a dense cluster, is
    searched from each member in turn among those not yet reached.
    """
    rng = np.random.default_rng(len(fp))
    a, b = [], []
    open_ = [np.arange(len(fp))]
    while open_:
        rows = open_.pop()
        part = fp[rows]
        if len(rows) > leaf:
            point, radius, larger = split(part, distance, rng.choice(part, TRIES, replace=False))
            if larger <= 0.95 * len(rows):
                apart = np.bitwise_count(part ^ point)
                open_ += [rows[apart <= radius + distance], rows[apart > radius]]
                continue
        near = np.flatnonzero((np.bitwise_count(part[:, None] ^ part[None, :]) <= distance).sum(axis=1) > 1) if len(rows) <= leaf else np.arange(len(rows))
        x, y = _forest(part[near], distance)
        a.append(rows[near[x]])
        b.append(rows[near[y]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def near_links(distinct: DataFrame, distance: int, shard: int = SHARD) -> DataFrame:
    """Links (src, dst) that connect whatever ``distinct`` (fp: long, each once; a written table) holds within ``distance`` bits.

    The upper levels of a vantage-point tree, over a sample of some 64
    fingerprints a shard (``MOST_SAMPLE`` at most), part the rows into shards
    of about ``shard`` rows (``MOST_SHARDS`` at most).  Every row is placed in
    its own shard and in those that its ball of ``distance`` bits overlaps (see
    ``Tree.shards``), and each shard is searched exactly by the tree's lower
    levels.  Links form a forest in each leaf, never all pairs.
    """
    ship(distinct.sparkSession)
    number = distinct.count()
    depth = max(0, min(MOST_SHARDS, -(-number // shard)) - 1).bit_length()
    wanted = min(MOST_SAMPLE, 64 << depth)
    # the rows below a hash, which are the same in each run
    chosen = distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(max(1, number // wanted))) == 0).limit(2 * MOST_SAMPLE)
    sample = np.array([r.fp for r in chosen.select("fp").collect()] if depth else [], np.int64).view(np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(tree_of(np.sort(sample), depth, distance))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number = tree.value.shards(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0).take(pa.array(row))], ["shard", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in keyed_runs(batches, 1):
            fp = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            a, b = shard_links(fp, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["src", "dst"])

    placed = distinct.select("fp").mapInArrow(released(place), "shard long, fp long")
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(released(search), "src long, dst long")


def near_groups(docs: DataFrame, words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints within ``distance`` bits are linked; component_id is the
    smallest doc_id that links reach, the row's own included.  Equal
    fingerprints are one class throughout, so copies cost a row each and no
    pairs.  Rows without an id are linked like others and lend no id; a
    component without any id has a null one.  Repeated rows come out as often
    as they went in.  An empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs, words, seed), "fp")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = components(near_links(classes, distance), "links")
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.drop("least_id").join(least, "root").select(F.col("fp").alias("class_fp"), "component_id")
    named = materialize(named, "named")
    return rows.join(named, rows["fp"] == named["class_fp"]).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL: str | None = None
