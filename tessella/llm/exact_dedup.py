"""Exact deduplication by two passes of Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import SPACE, documents, materialize
from tessella.llm.textkernel import mapped, released
from tessella.session import ship

#: Cells of the filter at most; two bits each, so 16 MB are broadcast whatever the input.
MAX_CELLS = 1 << 26
PROBES = 3
SEGMENTS = 16
#: Ranges of keys at most that are filtered one after another; beyond, all rows are grouped.
MOST_RANGES = 64
#: Cells a row that a range of keys has at least: so some 1 % of unique rows look repeated.
CELLS_A_ROW = 12


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _cells(key: np.ndarray, cells: int) -> list[np.ndarray]:
    a, b = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(cells)).astype(np.int64) for i in range(PROBES)]


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def filter_cells(rows: int, max_cells: int = MAX_CELLS) -> int:
    """Some 24 cells a row, up to ``max_cells``."""
    return min(max_cells, 1 << max(12, int(np.ceil(np.log2(24 * max(rows, 1))))))


def passes(bits: np.ndarray, cells: int, key: np.ndarray) -> np.ndarray:
    """Whether all cells of each key (uint64) are marked."""
    hit = np.ones(len(key), bool)
    for cell in _cells(key, cells):
        hit &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _portions(key: np.ndarray, most: int = 1 << 17) -> list[np.ndarray]:
    return [key[low : low + most] for low in range(0, len(key), most)]


def _first_column(batch: pa.RecordBatch) -> np.ndarray:
    return _keys(batch.column(0))


def filter_bits(keys: DataFrame, cells: int, repeated: bool = True, read: Callable[[pa.RecordBatch], np.ndarray] = _first_column) -> np.ndarray:
    """Bits of the cells that two or more of ``keys`` have hit, or one, unless ``repeated``.

    ``keys`` has one in each row (key: long), or whatever ``read`` takes out of
    a batch of them (uint64).

    Each task holds a cell's count as none, one or more; tasks' filters merge
    segment by segment on the executors.  Only the bits of "more", whose size
    is fixed by ``cells``, reach the driver.
    """
    ship(keys.sparkSession)
    part = cells // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # hits of each cell, up to two
        hits_of = np.zeros(cells, np.uint8)
        for key in (part for batch in batches for part in _portions(read(batch))):
            probes = np.stack(_cells(key, cells))
            # a key's own probes may meet in one cell, which it then hits once only
            probes.sort(axis=0)
            fresh = np.ones(probes.shape, bool)
            fresh[1:] = probes[1:] != probes[:-1]
            cell, hits = np.unique(probes[fresh], return_counts=True)
            hits_of[cell] = np.minimum(hits_of[cell] + np.minimum(hits, 2), 2) if repeated else 2
        for s in range(SEGMENTS):
            held = hits_of[s * part : (s + 1) * part]
            if held.any():
                packed = [zlib.compress(np.packbits(held >= least).tobytes(), 1) for least in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], ["segment", "once", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if s in held:
                    c, d = held[s]
                    a, b = a | c, b | d | (a & c)
                held[s] = (a, b)
        for s, (_, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], ["segment", "more"])

    counted = keys.mapInArrow(released(count), "segment int, once binary, more binary")
    merged = counted.repartition(SEGMENTS, "segment").mapInArrow(released(merge), "segment int, more binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.collect():
        bits[row.segment * part // 8 : (row.segment + 1) * part // 8] = np.frombuffer(zlib.decompress(row.more), np.uint8)
    return bits


def ranges_of(rows: int, max_cells: int = MAX_CELLS) -> list[tuple[int, int]]:
    """Ranges of 64-bit keys, each of which has ``CELLS_A_ROW`` cells a row in a filter of its own; one, if that has them all."""
    number = 1 if rows * CELLS_A_ROW <= max_cells else -(-rows * CELLS_A_ROW // max_cells)
    edges = [-(1 << 63) + (1 << 64) * k // number for k in range(number + 1)]
    return [(low, high - 1) for low, high in zip(edges, edges[1:])]


def tested(rows: DataFrame, key: str, max_cells: int = MAX_CELLS, only_maybe: bool = False) -> DataFrame:
    """``rows`` with a column tessella_maybe: false only where no other row has the same number in column ``key``.

    ``rows`` is a written table, or little more than one.  Its filter has 12 cells a row at least: more
    rows than one filter of ``max_cells`` can tell apart are taken in ranges
    of keys, one after another, each with a filter of its own.  The table is
    then sorted by key within its files, so that a range reads little else, and
    nothing is shuffled.  So some 1 % of unique rows are taken for repeated
    ones, up to ``MOST_RANGES`` ranges (0.35 billion rows at the default ``max_cells``, which clusters with larger workers may raise);
    beyond that all rows are.
    """
    number = rows.count()
    ranges = ranges_of(number, max_cells)
    if len(ranges) > MOST_RANGES:
        return rows if only_maybe and "tessella_maybe" in rows.columns else rows.withColumn("tessella_maybe", F.lit(True))
    cells = filter_cells(-(-number // len(ranges)), max_cells)
    if len(ranges) > 1:
        rows = materialize(rows.sortWithinPartitions(key), "sorted")
    parts = []
    for low, high in ranges:
        part = rows if len(ranges) == 1 else rows.where(F.col(key).between(low, high))
        bits = filter_bits(part.select(F.col(key).alias("key")), cells)
        part = marked_rows(part, key, bits, cells)
        parts.append(materialize(part.where("tessella_maybe") if only_maybe else part, "tested"))
    if len(parts) == 1:
        return parts[0]
    return rows.sparkSession.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()])


def maybe_repeated(rows: DataFrame, key: str, max_cells: int = MAX_CELLS) -> DataFrame:
    """Those of ``rows``, a written table or little more than one, whose number in column ``key`` another row may have: all that have one, and few others."""
    return tested(rows, key, max_cells, only_maybe=True).drop("tessella_maybe")


Unpack = Callable[[pa.RecordBatch], tuple[np.ndarray, list[pa.Array]]]


def maybe_shared(packed: DataFrame, number: int, unpack: Unpack, schema: str, max_cells: int = MAX_CELLS) -> DataFrame:
    """Rows (key: long, and more) that ``unpack`` takes out of batches of ``packed``, but for most whose key (uint64) no other one has.

    ``number`` tells how many there are.  Rows without an equal are left out by
    a Bloom filter, or several, as in ``tested``; all pass where there are too
    many for that.
    """
    ranges = ranges_of(number, max_cells)
    if len(ranges) > MOST_RANGES:
        ranges = [(-(1 << 63), (1 << 63) - 1)]
        cells = 0
    else:
        # as many cells a row at every size, so that as many rows pass by mistake
        cells = min(max_cells, max(1 << 12, -(-number * CELLS_A_ROW // (len(ranges) * 8 * SEGMENTS)) * 8 * SEGMENTS))
    names = [part.split()[0] for part in schema.split(",")]
    parts = []
    for low, high in ranges:

        def inside(key: np.ndarray, low: int = low, high: int = high) -> np.ndarray:
            signed = key.view(np.int64)
            return (signed >= low) & (signed <= high)

        def read(batch: pa.RecordBatch, inside=inside) -> np.ndarray:
            key = unpack(batch)[0]
            return key[inside(key)] if len(ranges) > 1 else key

        bits = packed.sparkSession.sparkContext.broadcast(filter_bits(packed, cells, read=read) if cells else None)

        def test(batches: Iterator[pa.RecordBatch], bits=bits, inside=inside) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, columns = unpack(batch)
                hit = inside(key)
                if cells:
                    hit &= passes(bits.value, cells, key)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in (pa.array(key.view(np.int64)), *columns)], names)

        parts.append(packed.mapInArrow(released(test), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    First pass: a Bloom filter with saturating counts marks the cells that two
    rows have hit.  Second pass: only rows all of whose cells are marked are
    grouped by their hash; the others have no equal and pass straight through.
    Beyond ``max_cells`` the hashes are filtered range by range (see ``tested``).

    A null text counts as empty, of any number of empty texts one stays.  Equal
    rows that also share the doc_id are one group of which one row stays.  Null
    ids come after all others.  An empty table gives an empty one; other
    columns of ``docs`` are not read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _hash(docs["text"]).alias("hash"), F.monotonically_increasing_id().alias("row_no"))
    marked, groups = _repeats(rows, max_cells)
    again = marked.where("maybe")
    joined = again.join(groups, again["hash"] == groups["group_hash"])
    text_sha256 = F.lower(F.hex("hash")).alias("text_sha256")
    repeated = joined.select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), text_sha256)
    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha256)
    return alone.unionByName(repeated)


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def marked_rows(rows: DataFrame, key: str, bits: np.ndarray, cells: int, name: str = "tessella_maybe") -> DataFrame:
    """``rows`` with a column ``name``: whether the filter holds all cells of the number in column ``key``."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(held.value, cells, _keys(batch.column(batch.schema.get_field_index(key))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, name])

    return mapped(rows, test, schema)


def _repeats(rows: DataFrame, max_cells: int) -> tuple[DataFrame, DataFrame]:
    """Both passes over (doc_id, hash, row_no and more): the rows with a column maybe, and the groups of those."""
    rows = materialize(rows.withColumn("key", F.xxhash64("hash")), "sha")
    marked = tested(rows, "key", max_cells).drop("key").withColumnRenamed("tessella_maybe", "maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row_no").alias("row_no"))).alias("first")
    groups = marked.where("maybe").groupBy(F.col("hash").alias("group_hash")).agg(first, F.count("*").alias("group_size"))
    groups = groups.select("group_hash", F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_row"), "group_size")
    return marked, materialize(groups, "groups")


def row_mark(text: Column) -> Column:
    """What tells rows that share a doc_id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_copies(docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay.

    Only ids and hashes are grouped; which rows go is told by ``without_rows``.
    Null texts count as empty, null ids come after all others, and of rows that
    share both doc_id and text one stays.  An empty table gives an empty one.
    """
    mark = row_mark(docs["text"]).alias("mark")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _hash(docs["text"]).alias("hash"), mark, F.monotonically_increasing_id().alias("row_no"))
    marked, groups = _repeats(rows, max_cells)
    again = marked.where("maybe")
    late = again.join(groups.where("group_size > 1"), again["hash"] == groups["group_hash"])
    # a row that equals the one that stays in text and id cannot be told from it, so that one of them stays
    stays = F.max((F.col("row_no") == F.col("keep_row")).cast("int"))
    classes = late.groupBy("hash", "doc_id", "mark").agg(stays.alias("stays"), F.count("*").alias("n"))
    going = classes.where("stays = 0 or n > 1").select("doc_id", "mark", (F.col("stays") == 1).alias("one_stays"))
    return without_rows(docs, materialize(going, "going"), marked.select("doc_id", "mark"))


def without_rows(docs: DataFrame, going: DataFrame, known: DataFrame, max_cells: int = 4 * MAX_CELLS) -> DataFrame:
    """``docs`` but for the rows of ``going`` (doc_id, mark, one_stays; a written table); all columns stay.

    Rows are told by doc_id, null or not, and by ``row_mark`` of their text;
    where one_stays holds, one of the rows alike stays.  A Bloom filter of what
    goes lets other rows pass.  Which rows of ``known`` (doc_id and mark of all
    rows) it holds though they stay, is found out by ids alone, and a second
    filter holds those: a row in the first one only goes without having been
    moved.  Just the few in both, and those of which one stays, are joined.
    The filters have some 24 cells a row, up to ``max_cells`` (32 MB of bits);
    far beyond that more rows are joined, with the same result.
    """
    key = F.xxhash64("doc_id", "mark")
    same = lambda a, b: a["doc_id"].cast("long").eqNullSafe(b["gone_id"]) & (a["tessella_mark"] == b["gone_mark"])
    gone = going.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "one_stays")
    cells = filter_cells(going.count(), max_cells)
    first = filter_bits(going.select(key.alias("key")), cells, repeated=False)
    hit = marked_rows(known.select("doc_id", F.col("mark").alias("tessella_mark"), key.alias("key")), "key", first, cells).where("tessella_maybe")
    wrong = materialize(hit.join(gone.where("not one_stays"), same(hit, gone), "left_anti").select("key"), "held_wrongly")
    more = filter_cells(wrong.count(), max_cells)
    second = filter_bits(wrong, more, repeated=False)
    wide = docs.withColumn("tessella_mark", row_mark(docs["text"])).withColumn("tessella_key", F.xxhash64(docs["doc_id"].cast("long"), F.col("tessella_mark")))
    wide = marked_rows(marked_rows(wide, "tessella_key", first, cells), "tessella_key", second, more, "tessella_moves")
    free = wide.where("not tessella_maybe").select(*docs.columns)
    moved = wide.where("tessella_maybe and tessella_moves")
    moved = moved.join(gone, same(moved, gone), "left").where("one_stays is null or one_stays")
    passing = moved.where("one_stays is null").select(*docs.columns)
    single = moved.where("one_stays").dropDuplicates(["gone_id", "gone_mark"]).select(*docs.columns)
    return free.unionByName(passing).unionByName(single)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM hashed
WINDOW same AS (PARTITION BY text_sha256)
"""
