"""Groups of candidates out of MinHash bands, and exact links within them, without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.exact_dedup import MAX_CELLS, filter_bits, filter_cells, marked_rows, maybe_shared
from tessella.llm.graph import components
from tessella.llm.textkernel import mix, released
from tessella.session import ship

#: Members of a group that meet in one run; larger groups are dealt into such parts.
PART = 1024
RECALL = 0.995
MOST_BANDS = 16


def tuned_bands(similarity: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows) with the fewest permutations that find ``recall`` of pairs at ``similarity`` and at most a quarter of those at half of it."""
    found = lambda s, bands, rows: 1 - (1 - s**rows) ** bands
    good = [(b * r, b, r) for r in range(1, 9) for b in range(1, most + 1) if found(similarity, b, r) >= recall and found(similarity / 2, b, r) <= 0.25]
    return min(good)[1:] if good else (most, 1)


def band_hashes(flat: np.ndarray, index: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set (a run of ``flat`` between bounds in ``index``; none empty) a hash a band, of the minima of ``rows`` permutations of 32 bits."""
    out = np.zeros((len(index) - 1, bands), np.uint64)
    if not len(out):
        return out
    odd = np.random.default_rng(7).integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    high = (flat >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(odd):
            out[:, k // rows] = mix(out[:, k // rows] ^ np.minimum.reduceat(high * factor, index[:-1]), k // rows + 1)
    return out


def unpacked(column: pa.Array, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binary values, end to end, and the row of each."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw.view(kind), np.repeat(np.arange(len(column)), np.diff(off) // np.dtype(kind).itemsize)


def buckets(banded: DataFrame, name: str = "buckets") -> DataFrame:
    """(grp, node) of the buckets in which two or more nodes of ``banded`` (node: long, bands: binary, 64 bits each; a written table) meet.

    Only rows whose bucket a Bloom filter takes to be shared are shuffled, and
    of buckets with the same members, as the bands of near copies have, one is
    left.  A node may have several rows.
    """
    ship(banded.sparkSession)
    banded = banded.select("node", "bands")

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        values, row = unpacked(batch.column(1))
        return values, [batch.column(0).take(pa.array(row))]

    number = banded.agg(F.coalesce(F.sum(F.octet_length("bands")), F.lit(0))).first()[0] // 8
    rows = materialize(maybe_shared(banded, number, unpack, "grp long, node long"), name)
    # rows of one node are in as many buckets each, so that their number tells nothing apart
    hashed = F.xxhash64("node")
    marks = [F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(hashed).alias("odd"), F.sum(F.shiftrightunsigned(hashed, 33)).alias("sum")]
    met = rows.groupBy("grp").agg(*marks).where("low <> high")
    chosen = materialize(met.groupBy("n", "low", "high", "odd", "sum").agg(F.min("grp").alias("chosen")).select("chosen"), name)
    cells = filter_cells(chosen.count(), MAX_CELLS)
    few = marked_rows(rows, "grp", filter_bits(chosen.select(F.col("chosen").alias("key")), cells, repeated=False), cells).where("tessella_maybe")
    return materialize(few.join(chosen, few["grp"] == chosen["chosen"]).select("grp", "node").distinct(), name)


def bucket_links(members: DataFrame) -> DataFrame:
    """Links of every node of ``members`` (grp, node) to the least of its bucket."""
    least = materialize(members.groupBy(F.col("grp").alias("of")).agg(F.min("node").alias("dst")), "least")
    return members.join(least, members["grp"] == least["of"]).select(F.col("node").alias("src"), "dst")


def groups_of(links: DataFrame, bucketed: DataFrame, part: int = PART, name: str = "groups") -> DataFrame:
    """(grp, node): the components of ``links`` where they have ``part`` nodes at most, else the buckets of their nodes.

    So a node of a small component comes once; a large component, whose far
    ends never met in a bucket, is searched bucket by bucket.
    """
    found = components(links, name)
    sizes = materialize(found.groupBy(F.col("root").alias("of_root")).agg(F.count("*").alias("n")), name)
    sized = found.join(sizes, found["root"] == sizes["of_root"])
    small = sized.where(F.col("n") <= part).select(F.col("root").alias("grp"), "node")
    if sizes.where(F.col("n") > part).isEmpty():
        return materialize(small, name)
    large = materialize(sized.where(F.col("n") > part).select(F.col("node").alias("of_node")), name)
    return materialize(small.unionByName(bucketed.join(large, bucketed["node"] == large["of_node"]).select("grp", "node")), name)


def forest(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect whatever sets (sorted, distinct numbers) have a Jaccard similarity of ``threshold`` or more.

    From each member in turn its similar ones are found among those not yet
    reached, all at once; they are then searched from in their turn.  A group
    of n copies thus costs n links and few comparisons.
    """
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    left = np.ones(len(sets), bool)
    links = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            x = queue.pop()
            mine = sets[x]
            near = left & (sizes >= threshold * sizes[x] - 1e-9) & (sizes * threshold <= sizes[x] + 1e-9)
            if not near.any():
                continue
            if len(mine):
                which = np.flatnonzero(near)
                if len(which) * 4 < len(sets):
                    place = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in which])
                    values, of = flat[place], owner[place]
                else:
                    values, of = flat, owner
                at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                shared = np.bincount(of[mine[at] == values], minlength=len(sets))
                near &= shared >= threshold * (sizes + len(mine) - shared) - 1e-9
            for k in np.flatnonzero(near).tolist():
                links.append((x, k))
                queue.append(k)
            left &= ~near
        if not left.any():
            break
    return links


def between(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """For each set on the left the first one on the right that is similar enough, if any: enough where the right ones are connected."""
    sizes = np.array([len(s) for s in right])
    flat = np.concatenate(right) if len(right) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(right)), sizes)
    links = []
    for x, mine in enumerate(left):
        if not len(mine):
            near = sizes == 0
        else:
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            shared = np.bincount(owner[mine[at] == flat], minlength=len(right))
            near = shared >= threshold * (sizes + len(mine) - shared) - 1e-9
        hit = np.flatnonzero(near)
        if len(hit):
            links.append((x, int(hit[0])))
    return links


def keyed_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each run of equal values in the first ``keys`` columns (numbers), together."""
    at, held = None, []
    whole = lambda parts: parts[0] if len(parts) == 1 else pa.concat_batches(parts)
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((np.diff(values) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            key = tuple(values[:, low].tolist())
            if key != at and held:
                yield at, whole(held)
                held = []
            at = key
            held.append(batch.slice(low, high - low))
    if held:
        yield at, whole(held)


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end where the first column, a number, changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(np.diff(key))
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.concat_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


Pairs = Callable[[pa.RecordBatch, pa.RecordBatch | None], tuple[np.ndarray, np.ndarray]]


def _linked(dealt: DataFrame, keys: list[str], side: int | None, search: Pairs) -> DataFrame:
    """The links that ``search`` finds in each run of ``dealt``, whose column after the keys is node; ``side`` tells the column that parts a run in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in keyed_runs(batches, len(keys)):
            if side is None:
                a, b = search(rows, None) if rows.num_rows > 1 else (np.zeros(0, int), np.zeros(0, int))
                left = right = rows
            else:
                first = rows.column(side)
                left, right = rows.filter(first), rows.filter(pa.compute.invert(first))
                a, b = search(left, right) if left.num_rows and right.num_rows else (np.zeros(0, int), np.zeros(0, int))
            if len(a):
                yield pa.RecordBatch.from_arrays([left.column("node").take(pa.array(a)), right.column("node").take(pa.array(b))], ["src", "dst"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), "src long, dst long")


def search_links(members: DataFrame, search: Pairs, part: int = PART, name: str = "search") -> DataFrame:
    """(src, dst): links that connect whatever nodes of a group ``search`` finds to be near, with few rows for a large group.

    ``members``: grp long, node long and what ``search`` reads; a node comes
    once in a group.  ``search(rows, None)`` gives places (a, b) of links that
    connect all near rows; ``search(left, right)`` links enough for each left
    row and the right side, whose rows are connected already.

    A group of up to ``part`` nodes is one run.  A larger one is dealt into
    parts, each searched by itself.  What that connects is one node from then
    on: if one component holds most of the group, as in a cluster of near
    copies, its rows go to one run more, and only the others meet all parts
    and one another.  No pair of the group is left out, and no task holds more
    than two parts.
    """
    ship(members.sparkSession)
    columns = [c for c in members.columns if c not in ("grp", "node")]
    members = materialize(members.select("grp", "node", *columns), name)
    sizes = materialize(members.groupBy(F.col("grp").alias("of")).agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1"), name)
    joined = members.join(sizes, members["grp"] == sizes["of"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    links = _linked(joined.select("grp", own.alias("own"), "node", *columns), ["grp", "own"], None, search)
    if sizes.where("parts > 1").isEmpty():
        return links
    links = materialize(links, name)
    large = sizes.where("parts > 1").select("of")
    wide = materialize(members.join(large, members["grp"] == large["of"]).select("grp", "node"), name)
    label = components(links, name)
    labelled = wide.join(label.withColumnRenamed("node", "label_node"), wide["node"] == F.col("label_node"), "left").select("grp", "node", F.coalesce("root", "node").alias("label"))
    labelled = materialize(labelled, name)
    counted = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"))
    most = counted.groupBy(F.col("grp").alias("of")).agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    most = materialize(most.select("of", F.col("most.label").alias("base"), F.col("most.n").alias("base_n"), (F.col("all") - F.col("most.n")).alias("rest_n")).where("rest_n > 0"), name)
    parts = lambda n: F.ceil(F.col(n) / F.lit(part)).cast("int")
    left = labelled.join(most, labelled["grp"] == most["of"]).select("grp", "node", (F.col("label") == F.col("base")).alias("in_base"), parts("base_n").alias("base_parts"), parts("rest_n").alias("rest_parts"))
    left = left.withColumnsRenamed({"grp": "of_grp", "node": "of_node"})
    rows = materialize(members.join(left, (members["grp"] == left["of_grp"]) & (members["node"] == left["of_node"])).drop("of_grp", "of_node"), name)
    hashed = F.xxhash64("node", F.lit(1))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # rows outside of the largest component, by parts, against its parts
    rest = rows.where("not in_base").withColumn("i", F.pmod(hashed, F.col("rest_parts")).cast("int"))
    base = rows.where("in_base").withColumn("j", F.pmod(hashed, F.col("base_parts")).cast("int"))
    met = rest.withColumn("j", F.explode(span("base_parts"))).unionByName(base.withColumn("i", F.explode(span("rest_parts"))))
    across = _linked(met.select("grp", "i", "j", "node", (~F.col("in_base")).alias("left"), *columns), ["grp", "i", "j"], 4, search)
    # and against one another
    pair = rest.withColumn("other", F.explode(span("rest_parts"))).withColumns({"a": F.least("i", "other"), "b": F.greatest("i", "other")})
    among = _linked(pair.select("grp", "a", "b", "node", *columns), ["grp", "a", "b"], None, search)
    return links.unionByName(across).unionByName(among)


def links_within(members: DataFrame, threshold: float, part: int = PART) -> DataFrame:
    """(src, dst) between nodes of one group whose sets are similar enough: all that is needed to connect them.

    ``members``: grp long, node long, items array<long> (a set; empty ones are
    similar to one another), one row a node of a group.  See ``search_links``.
    """

    def sets(rows: pa.RecordBatch) -> list[np.ndarray]:
        lists = rows.column("items")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        return [np.sort(values[a:b]) for a, b in zip(offsets, offsets[1:])]

    def search(left: pa.RecordBatch, right: pa.RecordBatch | None) -> tuple[np.ndarray, np.ndarray]:
        links = forest(sets(left), threshold) if right is None else between(sets(left), sets(right), threshold)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return search_links(members, search, part, "members")
