"""What the operators share: tables in the shared folder, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import materialize, release, ship

__all__ = ["SPACE", "WORD", "bounded_texts", "documents", "fold_of", "materialize", "release", "unit_hash"]

#: The white space of the contracts, as a Java or DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def unit_hash(*columns: Column) -> Column:
    """A number in (0, 1), the same in each run and in any SQL engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def bounded_texts(docs: DataFrame, chosen: DataFrame, group: str, each: int) -> list:
    """Rows (doc_id, group, text): for each value of ``group`` up to ``each`` of the ids in ``chosen``, by smallest hash.

    Only ids are compared to make the choice; the texts of the chosen few are
    then fetched by a join with a list of at most ``each`` ids a group.  Of rows
    that share an id the smallest text counts.
    """
    spark = docs.sparkSession
    ship(spark)
    known = chosen.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(group).alias("group"))
    # of a large group only the rows below a hash reach the driver: some four times as many as are taken
    counts = known.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("rows"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    near = known.join(counts, F.col("group") == F.col("of")).where(place * F.col("rows") <= 4.0 * each).select("doc_id", "group")
    ids = near.groupBy("doc_id").agg(F.min("group").alias("group")).select("doc_id", "group", F.xxhash64("doc_id").alias("place")).collect()
    by_group: dict = {}
    for r in sorted(ids, key=lambda r: (r.place, r.doc_id)):
        by_group.setdefault(r.group, []).append(r)
    ids = [r for rows in by_group.values() for r in rows[:each]]
    if not ids:
        return []
    schema = T.StructType([T.StructField("wanted", T.LongType()), T.StructField("group", chosen.schema[group].dataType)])
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, r.group) for r in ids], schema))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = texts.join(wanted, F.col("doc_id") == F.col("wanted")).groupBy("doc_id", "group").agg(F.min("text").alias("text"))
    return sorted(found.collect(), key=lambda r: r.doc_id)
