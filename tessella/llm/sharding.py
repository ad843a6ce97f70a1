"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import documents, materialize

SHARDS = 8
CELL_BITS = 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``cells`` (rows, dimensions), all below 2 ** bits.

    By the Gray-code form of the curve: from the highest bit down, the bits of
    each dimension turn or swap the lower ones; the transposed result is read
    off bit by bit.  bits times dimensions must not pass 63.
    """
    axes = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    if not axes or bits * len(axes) > 63:
        raise ValueError("bits times dimensions must be 1 to 63")
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for k, axis in enumerate(axes):
            on = (axis & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axis) & lower)
            axes[0] ^= np.where(on, lower, swap)
            if k:
                axis ^= swap
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    index = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ turn) >> level) & 1)
    return index


def numbered(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """(``rows`` in order of ``keys`` with a column rank from 0, their number), by range partitions that are numbered apart.

    Only the partitions' counts reach the driver.
    """
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("serial", F.monotonically_increasing_id())
    ordered = materialize(ordered, name)
    part, place = F.shiftright("serial", 33), F.col("serial").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "start_part long, start long")
    joined = ordered.withColumn("part", part).join(F.broadcast(starts), F.col("part") == F.col("start_part"))
    return joined.withColumn("rank", F.col("start") + place).drop("serial", "part", "start_part", "start"), total


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the rank of each whole value among the distinct ones in place of ``column``; null stays null."""
    values = materialize(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), "values")
    ranks = materialize(numbered(values, ["value"], "values")[0], "ranks")
    return rows.join(ranks, rows[column] == ranks["value"], "left").drop(column, "value").withColumnRenamed("rank", column)


def shard(docs: DataFrame, dimensions: dict[str, Column], shards: int = SHARDS, bits: int = CELL_BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) for every row of ``docs``.

    Each dimension (a number, or a string, which counts by its rank among the
    distinct values; null is lowest) is cut at its approximate quantiles into
    up to 2 ** bits cells, so a file of a shard spans few cells of each.  Rows
    in order of the Hilbert index, then text, then id, are cut into ``shards``
    runs whose counts differ by one at most; slot counts a run's rows from 0.

    A null text has no bytes.  Repeated rows take a slot each, and even so many
    of them fill several partitions.  An empty table gives an empty one.
    """
    names = [f"d{k}" for k in range(len(dimensions))]
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_no"),
        *[c.alias(n) for n, c in zip(names, dimensions.values())],
    )
    words = [f.name for f in rows.schema.fields if f.name in names and isinstance(f.dataType, T.StringType)]
    rows = rows.withColumns({n: F.col(n).cast("long") for n in names if n not in words})
    rows = materialize(rows, "shard")
    for n in words:
        rows = value_ranks(rows, n)
    rows = rows.select("doc_id", "size", "text_crc32", "row_no", *names)
    steps = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    found = rows.agg(*[F.percentile_approx(n, steps, 2000).alias(n) for n in names]).first()
    edges = [np.unique(np.array(found[n] or [], np.int64)) for n in names]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, len(names)), np.int64)
            for k, n in enumerate(names):
                column = batch.column(batch.schema.get_field_index(n))
                value = column.fill_null(0).to_numpy(zero_copy_only=False)
                cells[:, k] = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges[k], value, side="right"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hilbert(cells, bits))], ["doc_id", "size", "text_crc32", "row_no", "curve"])

    curved = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, row_no long, curve long")
    # row_no parts rows that are alike in all else, which the ranges could not
    ranked, total = numbered(curved, ["curve", "text_crc32", "doc_id", "size", "row_no"], "ordered")
    run = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", run.cast("int")).withColumn("slot", F.col("rank") - first).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    dimensions = {"source": docs["source"], "lang": docs["lang"], "length": F.octet_length(docs["text"]), "doc_id": docs["doc_id"]}
    out = shard(docs, dimensions)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


SQL: str | None = None
