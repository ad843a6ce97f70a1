"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize

K = 20
BINS = 256
#: Queries that are sent to the workers at once, and that meet ``CHUNK`` candidates in one matrix product.
GROUP = 1 << 15
QUERY_BLOCK = 1024
CHUNK = 2048


def _vectors(column: pa.Array, width: int, kind: type) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<i8").reshape(len(column), width).astype(kind)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector): each component as floor(scale * x); rows with null or non-finite parts are left out."""
    x = F.col("embedding")
    good = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    good = good.where(x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    return good.select("vec_id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("vector"))


class Scorer:
    """Scores of chunks of candidates (row_no, vec_id, vector) against blocks of queries."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, low: np.ndarray, want: np.ndarray):
        self.rows, self.vectors, self.low, self.want = rows, vectors, low, want

    def each(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first query, candidates' vec_id, scores, which are of a query's own row)."""
        for low in range(0, batch.num_rows, CHUNK):
            part = batch.slice(low, CHUNK)
            row, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            candidates = _vectors(part.column(2), self.vectors.shape[1], self.vectors.dtype.type).T
            for a in range(0, len(self.rows), QUERY_BLOCK):
                yield a, ids, self.vectors[a : a + QUERY_BLOCK] @ candidates, self.rows[a : a + QUERY_BLOCK, None] == row[None, :]


def _histogram(scorer: Scorer, step: int, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, bin, n): counts of scores in bins from each query's low on, but for bins below a task's own ``top`` highest scores."""
    counts = np.zeros((len(scorer.rows), BINS + 1), np.int32)
    for batch in batches:
        for a, _, scores, own in scorer.each(batch):
            place = np.floor_divide(scores - scorer.low[a : a + len(scores), None], step)
            # beyond the range of an inner level lie only scores already counted
            place[own | (place < 0) | (place >= BINS)] = -1
            flat = (place + 1).astype(np.int64) + np.arange(len(scores))[:, None] * (BINS + 1)
            counts[a : a + len(scores)] += np.bincount(flat.ravel(), minlength=len(scores) * (BINS + 1)).reshape(-1, BINS + 1).astype(np.int32)
    for a in range(0, len(counts), QUERY_BLOCK):
        down = counts[a : a + QUERY_BLOCK, :0:-1].astype(np.int64)
        row, column = np.nonzero((down > 0) & (np.cumsum(down, axis=1) - down < top))
        lows = scorer.low[a + row].astype(np.int64) + (BINS - 1 - column) * step
        yield pa.RecordBatch.from_arrays([pa.array(a + row), pa.array(lows), pa.array(down[row, column])], ["query", "bin", "n"])


def _above(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, vec_id, score): what lies above each query's k-th score, and of a task's ties no more than are wanted, smallest ids first."""
    above, ties = [], []

    def fewer() -> None:
        query, ids, scores = (np.concatenate(x) for x in zip(*ties))
        order = np.lexsort((ids, query))
        query, ids, scores = query[order], ids[order], scores[order]
        few = np.arange(len(query)) - np.searchsorted(query, query) < scorer.want[query]
        ties[:] = [(query[few], ids[few], scores[few])]

    for batch in batches:
        for a, ids, scores, own in scorer.each(batch):
            low = scorer.low[a : a + len(scores), None]
            for kept, hit in ((above, scores > low), (ties, scores == low)):
                query, column = np.nonzero(hit & ~own)
                if len(query):
                    kept.append((a + query, ids[column], scores[query, column].astype(np.int64)))
        if sum(len(x[0]) for x in ties) > 1_000_000:
            fewer()
    if ties:
        fewer()
    for part in above + ties:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["query", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: int = 64, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Queries are the rows whose vec_id ``every`` divides, candidates all rows
    but the query's own; ties go to the smaller vec_id.  Candidates stay where
    they lie; ``group`` queries at a time, some 16 MB of them, are sent to all
    workers.  All scores are made, block by block: first into a histogram of
    256 bins a query, whose sums over all tasks give the bin of the k-th value,
    then into bins within that bin, and so on until a bin is one score wide.  A
    last pass passes on what lies above that score, and of each task's ties no
    more than are wanted.

    Rows without an id, null vectors and those with a null or non-finite
    component take no part.  Rows that share an id are candidates each, also
    for one another, and queries each.  Shorter vectors count as if filled
    with zeros.  With fewer than k candidates all are returned; an empty table
    gives an empty one.  Scores must stay below 2 ** 52, else it raises an
    error.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, scale), "vectors")
    size = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(size).alias("norm")).first()
    if not found.n or found.n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, bound = max(found.width, 1), int(found.norm) + 1
    if bound >= 1 << 52:
        raise ValueError("components are too large for exact scores")
    # products and differences from a bound are whole numbers that both kinds of number hold exactly
    kind = np.float32 if bound < 1 << 21 else np.float64

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(length), width), "<i8")
            out[np.arange(width)[None, :] < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            whole = pa.py_buffer(out.tobytes())
            offsets = pa.py_buffer(np.arange(len(out) + 1, dtype=np.int64) * 8 * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(out), [None, offsets, whole]).cast(pa.binary())], ["row_no", "vec_id", "vector"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", "vector")
    rows = materialize(numbered.mapInArrow(packed, "row_no long, vec_id long, vector binary"), "packed")
    chosen = materialize(rows.where(F.col("vec_id") % every == 0), "queries")
    groups = max(1, -(-chosen.count() // group))
    widest = 1
    while widest * BINS < 2 * bound + 1:
        widest *= BINS
    results = []
    for number in range(groups):
        heads = chosen.where(F.pmod(F.xxhash64("row_no"), F.lit(groups)) == number).toArrow().combine_chunks()
        if not heads.num_rows:
            continue
        ids, own = heads.column("vec_id").to_numpy(), heads.column("row_no").to_numpy()
        asked = np.concatenate([_vectors(c, width, kind) for c in heads.column("vector").chunks])
        low, want = np.full(len(ids), -bound, kind), np.full(len(ids), k)
        step = widest
        while step:
            sent = spark.sparkContext.broadcast((own, asked, low, want))

            def count(batches, sent=sent, step=step):
                return _histogram(Scorer(*sent.value), step, k, batches)

            bins = rows.mapInArrow(count, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("query").orderBy(F.col("bin").desc())
            ran = bins.withColumn("upto", F.sum("n").over(down)).withColumn("before", F.col("upto") - F.col("n"))
            # the bin in which each query's k-th value lies; a query with fewer candidates keeps the lowest bound and gets all
            wanted = F.broadcast(spark.createDataFrame(pa.table({"asked": pa.array(np.arange(len(want))), "want": pa.array(want)})))
            passed = ran.join(wanted, F.col("query") == F.col("asked")).where("upto >= want")
            for r in passed.groupBy("query").agg(F.max(F.struct("bin", "before")).alias("hit")).collect():
                low[r.query], want[r.query] = r.hit.bin, want[r.query] - r.hit.before
            sent.unpersist()
            step = step // BINS if step > 1 else 0
        sent = spark.sparkContext.broadcast((own, asked, low, want))

        def last(batches, sent=sent):
            return _above(Scorer(*sent.value), batches)

        names = spark.createDataFrame(pa.table({"named": pa.array(np.arange(len(ids))), "query_id": pa.array(ids)}))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        best = rows.mapInArrow(last, "query long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results.append(materialize(best.join(F.broadcast(names), F.col("query") == F.col("named")).select("query_id", "rank", "vec_id", "score"), "top"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(results[0].schema).parquet(*[f for r in results for f in r.inputFiles()])


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH good AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.row_no <> c.row_no WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
WHERE rank <= 20
"""
