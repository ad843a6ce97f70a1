"""Mixing sources to target weights: weighted sampling without replacement to a budget of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, documents, materialize, unit_hash
from tessella.llm.exact_dedup import row_mark

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Each of two histogram levels has so many bins, by powers of two.
BIN_BITS = 12


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_cell(text: Column) -> Column:
    """The cell of a grid in which a text lies: 21 levels of the share of solid characters that are no ASCII digits or signs, 32 of their number a word; -1 without any."""
    solid = F.length(F.regexp_replace(text, r"[\x09-\x0D\x20]+", "")).cast("long")
    letters = F.length(F.regexp_replace(text, r"[\x09-\x40\x5B-\x60\x7B-\x7E]+", "")).cast("long")
    parts = F.struct(solid.alias("solid"), letters.alias("letters"), words_of(text).alias("words"))
    # bound once, by an array of one
    cell = lambda p: F.when(p["solid"] > 0, F.floor(20 * p["letters"] / p["solid"]) * 32 + F.least(F.lit(31), F.floor(2 * p["solid"] / p["words"]))).otherwise(-1)
    return F.coalesce(F.element_at(F.transform(F.array(parts), cell), 1), F.lit(-1)).cast("long")


def cell_weights(cells: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(weight_cell, weight) learned from ``labels`` (doc_id, quality 0 or 1): the share of good documents in each cell; and over all of them.

    ``cells``: doc_id, cell.  One good and one bad document are added to each
    count, so that weights lie between 0 and 1.  There are 673 cells at most.
    Of labels that share an id the highest counts; null ids and labels don't.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("quality").cast("long").alias("good"))
    counts = cells.join(marks, cells["doc_id"] == marks["of"]).groupBy("cell").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    counts = materialize(counts, "cells")
    whole = counts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return counts.select(F.col("cell").alias("weight_cell"), ((F.col("good") + 1) / (F.col("n") + 2)).alias("weight")), (whole.good + 1) / (whole.n + 2)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with weight and target.

    Sources in code-point order, null last, take ``weights`` in turn and divide
    ``share`` of all sizes; no target is over ``most`` times its source, and
    what that leaves is divided again.  In order of cap by weight, the level
    (words per unit of weight) rises from source to source; it is settled at
    the first source that stays under its cap.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everywhere = Window.partitionBy(F.lit(0))
    by_name = everywhere.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.get(cycle, turn)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = everywhere.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("place", F.row_number().over(by_cap)).withColumn("level", left / heavy)
    under = F.col("level") <= F.col("cap") / F.col("weight")
    settled = leveled.withColumn("first", F.min(F.when(under, F.struct("place", "level"))).over(everywhere))
    target = F.when(F.col("place") < F.coalesce(F.col("first.place"), F.lit(1 << 30)), F.col("cap")).otherwise(F.col("weight") * F.col("first.level"))
    return settled.select("source", "source_size", "weight", target.alias("target"))


def _cut(sums: DataFrame, code: str, start: Column, name: str) -> DataFrame:
    """Per source the first bin in which the running sum of sizes passes the budget, and the sum before it."""
    order = Window.partitionBy("source").orderBy(code)
    ran = sums.withColumn("upto", start + F.sum("bin_size").over(order))
    over = ran.where(F.col("upto") > F.col("rest"))
    found = over.groupBy("source").agg(F.min(F.struct(F.col(code).alias("bin"), (F.col("upto") - F.col("bin_size")).alias("before"))).alias("cut"))
    return found.select(F.col("source").alias(f"{name}_source"), F.col("cut.bin").alias(name), F.col("cut.before").alias(f"{name}_before"))


def _with(df: DataFrame, small: DataFrame, column: str) -> DataFrame:
    return df.join(small, df["source"].eqNullSafe(small[column]), "left").drop(column)


def _draws(docs: DataFrame, quality: Column | None, learned: bool) -> dict[str, Column]:
    """What tells rows apart in a draw, as columns over ``docs``: a hash of the text, the random number of id and text, and the weight or its cell."""
    text = docs["text"]
    weight = quality if quality is not None else F.lit(1.0)
    return {"mark": row_mark(text), "u": unit_hash(docs["doc_id"].cast("long"), text), "given": weight.cast("double"), "cell": quality_cell(text) if learned else F.lit(-1).cast("long")}


def _bins(rows: DataFrame, model: tuple[DataFrame, float] | None, prefix: str = "") -> DataFrame:
    """``rows`` (with the columns of ``_draws``) with key, high and low: the exponential key over the weight, and its bins."""
    u, weight = F.col(f"{prefix}u"), F.col(f"{prefix}given")
    if model is not None:
        table, default = model
        rows = rows.join(F.broadcast(table), rows[f"{prefix}cell"] == table["weight_cell"], "left").drop("weight_cell")
        weight = F.coalesce("weight", F.lit(default))
    key = -F.log(u) / weight
    code = F.floor((F.lit(1.0) - F.exp(-key)) * F.lit(float(1 << 2 * BIN_BITS)))
    code = F.least(code, F.lit((1 << 2 * BIN_BITS) - 1)).cast("long")
    rows = rows.withColumns({f"{prefix}key": key, f"{prefix}high": F.shiftright(code, BIN_BITS), f"{prefix}low": code.bitwiseAND(F.lit((1 << BIN_BITS) - 1))})
    return rows.drop("weight") if model is not None else rows


def _plan(docs: DataFrame, quality: Column | None, labels: DataFrame | None, weights: tuple, share: float, most: float) -> tuple[DataFrame, DataFrame, tuple | None]:
    """The rows' sizes, keys and bins; for each source its target, epochs and the bins where its budget ends; and the learned weights."""
    columns = [c.alias(n) for n, c in _draws(docs, quality, labels is not None).items()]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), words_of(docs["text"]).alias("size"), *columns)
    rows = materialize(rows, "mix")
    model = cell_weights(rows, labels) if labels is not None else None
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = _bins(rows, model).select("doc_id", "source", "mark", "size", "key", "high", "low")
    aims = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    aims = materialize(aims.withColumnRenamed("source", "aim_source"), "aims")
    sums = rows.groupBy("source", "high").agg(F.sum("size").alias("bin_size"))
    cut1 = materialize(_cut(_with(sums, aims, "aim_source"), "high", F.lit(0), "high_cut"), "cut1")
    ending = _with(rows, cut1, "high_cut_source").where(F.col("high") == F.col("high_cut"))
    sums = ending.groupBy("source", "low").agg(F.sum("size").alias("bin_size"), F.first("high_cut_before").alias("start"))
    cut2 = materialize(_cut(_with(sums, aims, "aim_source"), "low", F.col("start"), "low_cut"), "cut2")
    bounds = aims.join(cut1, aims["aim_source"].eqNullSafe(cut1["high_cut_source"]), "left").drop("high_cut_source")
    bounds = bounds.join(cut2, bounds["aim_source"].eqNullSafe(cut2["low_cut_source"]), "left").drop("low_cut_source")
    return rows, materialize(bounds, "bounds"), model


def _edge(high: Column, low: Column) -> Column:
    """Whether a row lies in the one bin of its source that the budget's end divides."""
    return F.coalesce((high == F.col("high_cut")) & (low == F.col("low_cut")), F.lit(False))


def _inside(high: Column, low: Column) -> Column:
    """Whether a row of any other bin lies before the budget's end."""
    before = F.col("high_cut").isNull() | (high < F.col("high_cut")) | ((high == F.col("high_cut")) & (low < F.col("low_cut")))
    return F.when(F.col("rest") <= 0, F.lit(False)).otherwise(before)


def _divided(placed: DataFrame) -> DataFrame:
    """The rows of the divided bins in order of their keys, with a column in: up to the one whose middle lies within the budget."""
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "mark")
    ran = F.col("low_cut_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.where(_edge(F.col("high"), F.col("low"))).withColumn("in", 2 * ran - F.col("size") <= 2 * F.col("rest"))


def mix(docs: DataFrame, quality: Column | None = None, labels: DataFrame | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) for every row of ``docs``.

    Efraimidis-Spirakis sampling.  Each document has the exponential key
    -ln(u) / quality, u hashed from its id and text; quality is the column
    given, or learned from ``labels`` (see ``cell_weights``), or 1.  A source
    gives first as many complete epochs as its target holds; the rest of the
    target is filled by documents in order of their keys, whole, up to that
    whose middle lies within it, so that a source misses its target by half a
    document at most.  ``repeats`` counts a document's appearances and
    taken = size * repeats.

    No source is sorted as a whole: sums of sizes over 4096 key bins, then over
    4096 parts of the bin where the budget ends, leave a few rows to order.

    A null text has size 0, a null source is a source; equal keys go by id,
    then size; repeated rows count each, those without an id or sharing one are
    drawn apart by their texts.  An empty table gives an empty one; other
    columns of ``docs`` are not read.
    """
    rows, bounds, _ = _plan(docs, quality, labels, weights, share, most)
    placed = _with(rows, bounds, "aim_source")
    high, low = F.col("high"), F.col("low")
    whole = placed.where(~_edge(high, low)).withColumn("in", _inside(high, low))
    repeats = F.col("epochs") + F.col("in").cast("long")
    return whole.unionByName(_divided(placed)).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def mixed(docs: DataFrame, quality: Column | None = None, labels: DataFrame | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each row as often as ``mix`` repeats it; all columns stay.

    Texts do not move: each row's bins tell whether it is in; only ids of the
    divided bins, a few for each source, are looked up.  Of rows alike in
    source, id and text, which a budget may divide, as many are in as ``mix``
    says, whichever they are; no others are moved, to be counted.
    """
    rows, bounds, model = _plan(docs, quality, labels, weights, share, most)
    late = _divided(_with(rows, bounds, "aim_source")).groupBy("source", "doc_id", "mark").agg(F.sum(F.col("in").cast("long")).alias("late_in"), F.count("*").alias("late_n"))
    late = materialize(late.withColumnsRenamed({"source": "late_source", "doc_id": "late_id", "mark": "late_mark"}), "late")
    bounds = bounds.withColumnsRenamed({c: f"mixed_{c}" for c in bounds.columns})
    wide = docs.withColumns({f"mixed_{n}": c for n, c in _draws(docs, quality, model is not None).items()})
    wide = _bins(wide, model, "mixed_")
    source, doc_id = wide["source"].cast("string"), wide["doc_id"].cast("long")
    wide = wide.join(bounds, source.eqNullSafe(bounds["mixed_aim_source"]))
    wide = wide.join(late, source.eqNullSafe(late["late_source"]) & doc_id.eqNullSafe(late["late_id"]) & (wide["mixed_mark"] == late["late_mark"]), "left")
    high, low = F.col("mixed_high"), F.col("mixed_low")
    cut, low_cut, rest = (F.col(f"mixed_{c}") for c in ("high_cut", "low_cut", "rest"))
    edge = F.coalesce((high == cut) & (low == low_cut), F.lit(False))
    before = cut.isNull() | (high < cut) | ((high == cut) & (low < low_cut))

    def repeated(rows: DataFrame, all_in: Column) -> DataFrame:
        taken = F.when(rest <= 0, F.lit(False)).when(edge, all_in).otherwise(before)
        out = rows.withColumn("mixed_repeats", (F.col("mixed_epochs") + taken.cast("long")).cast("int")).where("mixed_repeats > 0")
        return out.withColumn("mixed_no", F.explode(F.sequence(F.lit(1), F.col("mixed_repeats")))).select(*docs.columns)

    split = F.coalesce(edge & (F.col("late_in") > 0) & (F.col("late_in") < F.col("late_n")), F.lit(False))
    out = repeated(wide.where(~split), F.coalesce(F.col("late_in") > 0, F.lit(False)))
    if late.where("late_in > 0 and late_in < late_n").isEmpty():
        return out
    alike = Window.partitionBy("late_source", "late_id", "late_mark").orderBy("mixed_key")
    return out.unionByName(repeated(wide.where(split).withColumn("mixed_place", F.row_number().over(alike)), F.col("mixed_place") <= F.col("late_in")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(documents(spark, sf_dir), labels=labels).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    length(regexp_replace(text, '[\x09-\x0D\x20]+', '', 'g')) AS solid,
    length(regexp_replace(text, '[\x09-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS letters,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM documents),
celled AS (
  SELECT doc_id, source, size, u, CASE WHEN solid > 0 THEN (20 * letters // solid) * 32 + least(31, 2 * solid // size) ELSE -1 END AS cell FROM base),
marks AS (SELECT doc_id AS of, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
counts AS (SELECT cell AS weight_cell, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS n FROM celled JOIN marks ON doc_id = of GROUP BY 1),
keyed AS (
  SELECT doc_id, source, size,
    -ln(u) / coalesce((good + 1) / (n + 2), (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM counts)) AS key
  FROM celled LEFT JOIN counts ON cell = weight_cell),
s1 AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 2.0::DOUBLE AS cap,
    ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM keyed GROUP BY source),
s2 AS (
  SELECT *, row_number() OVER w AS place,
    ((SELECT sum(source_size) FROM s1) * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
settled AS (SELECT place, level FROM s2 WHERE level <= cap / weight ORDER BY place LIMIT 1),
aims AS (
  SELECT source, source_size,
    CASE WHEN place < coalesce((SELECT place FROM settled), 1073741824) THEN cap ELSE weight * (SELECT level FROM settled) END AS target
  FROM s2),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aims),
ran AS (
  SELECT k.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ran
"""
