"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source is a stream: its documents in an order fixed by a hash, repeated in whole epochs. A source's
weight may vary over training time t in [0, 1]; the integral of its schedule is its cumulative demand, and
its whole integral, scaled to the token budget, is its target. A document's words enter training where the
cumulative demand reaches their place in the stream, so inverting the demand gives each occurrence its
position, and a range sort by position gives the training order.

Schedules are piecewise linear, so demand is piecewise quadratic and inverts in closed form. Targets stop
at `max_epochs` times a source's size; what is above is shared out again by weight (one pass over the
sources ordered by the level at which they fill up). The running sum within a source is split into hash
buckets, so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, aside, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Course of each weight over time as knots (t, factor), in the order of WEIGHTS; each averages 1, so targets follow the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hex digits of the order key by which each source's running sum is split: 16^3 buckets.
DIGITS = 3


def words(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): shares of the whole size by weight, capped and redistributed.

    The i-th source by code point (null last) weighs weights[i mod n]. Sources fill up in the order of
    cap / weight; the level `lam` is where what the filled ones leave, spread over the other weights, no longer
    fills the next. One row per source, so the two windows over the whole table stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("_fill", F.col("_cap") / F.col("weight"))
    by_fill = Window.orderBy("_fill", "_rank")
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_caps")) / F.col("_rest"))
    ranked = ranked.withColumn("_lam", F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_level"))).over(everything)["_level"])
    return ranked.select("source", F.col("_rank").alias("source_rank"), "weight", "source_size", F.least("_cap", F.col("weight") * F.coalesce("_lam", F.lit(float("inf")))).alias("target"))


def position(u: Column, target: Column, schedule: Column) -> Column:
    """Time at which a source's cumulative demand reaches `u` of its `target` words.

    `schedule` is an array of knots (t, w) over [0, 1], t ascending: weights between knots are linear. Each
    segment's part of the integral is a trapezoid; within it the demand is quadratic in t.
    """
    segments = F.transform(F.slice(schedule, 1, F.size(schedule) - 1), lambda a, i: F.struct(a["t"].alias("t0"), a["w"].alias("w0"), F.get(schedule, i + 1)["t"].alias("t1"), F.get(schedule, i + 1)["w"].alias("w1")))
    area = lambda s: (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2
    whole = F.aggregate(segments, F.lit(0.0), lambda acc, s: acc + area(s))
    goal = F.when(target > 0, u / target * whole).otherwise(F.lit(0.0))

    def step(acc: Column, s: Column) -> Column:
        inside = F.greatest(goal - acc["done"], F.lit(0.0))
        slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * inside, F.lit(0.0)))
        at = s["t0"] + F.when(s["w0"] + root > 0, 2 * inside / (s["w0"] + root)).otherwise(F.lit(0.0))
        reached = acc["at"].isNull() & (goal <= acc["done"] + area(s))
        return F.struct((acc["done"] + area(s)).alias("done"), F.when(reached, F.least(at, s["t1"])).otherwise(acc["at"]).alias("at"))

    return F.coalesce(F.aggregate(segments, F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("at")), step, lambda acc: acc["at"]), F.lit(1.0))


def schedule_of(rank: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The knots (t, w) of the source of a given rank; schedules repeat as weights do."""
    each = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots]) for knots in schedules])
    return F.get(each, (rank % len(schedules)).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, size: Column | None = None) -> DataFrame:
    """Adds size, source_rank, source_size, target, taken and `_place` (words of the source's stream before the document).

    `taken` counts the words of all the document's occurrences in the first `target` words of its source's
    stream: whole epochs plus, for one document of a source, the part up to the target. Nulls: a null text has
    no words and is taken 0 times; null sources are one source, last; null or repeated doc_ids are ordered by size and
    text, and rows equal in all of these may swap places, which leaves the result the same. Texts of any length are counted
    whole; sources that fill up at one level do so in the order of their ranks. An empty table gives no rows. Columns of
    `docs` pass through, whatever their names, but for those named like the ones added.
    """
    docs, back = aside(docs.drop("size", "source_rank", "source_size", "target", "taken", "_place"), "_h", "_b", "_s", "_part", "_offset", "_run")
    sized = docs.withColumn("size", words() if size is None else size).withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.coalesce(F.xxhash64("text").cast("string"), F.lit("")))).cast("binary")))
    sized = sized.withColumn("_b", F.substring("_h", 1, DIGITS)).withColumn("_s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    parts = sized.groupBy("source", "_s", "_b").agg(F.sum("size").alias("_part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, max_epochs)
    within = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_s", "_b", F.coalesce(F.sum("_part").over(within), F.lit(0)).alias("_offset"))
    targets = targets.select(F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("_s"), "source_rank", "source_size", "target")
    offsets = offsets.join(targets, "_s")
    before = Window.partitionBy("_s", "_b").orderBy("_h", "size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_run", F.coalesce(F.sum("size").over(before), F.lit(0))).join(offsets, ["_s", "_b"])
    placed = placed.withColumn("_place", F.col("_offset") + F.col("_run"))
    goal = F.round("target").cast("long")
    taken = sum((F.least(F.greatest(goal - F.col("source_size") * e - F.col("_place"), F.lit(0)), F.col("size")) for e in range(max_epochs)), F.lit(0))
    return back(placed.withColumn("taken", taken.cast("long")).drop("_h", "_b", "_s", "_part", "_offset", "_run"))


def occurrences(mixed: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per occurrence of a document in the mix, with `words_taken` and its training `position`.

    Sorted by position across ranges of partitions: reading the partitions in order gives the curriculum.
    """
    mixed, back = aside(mixed.drop("words_taken", "position"), "_e")
    epochs = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.struct(e.alias("e"), F.least(F.greatest(F.round("target").cast("long") - F.col("source_size") * e - F.col("_place"), F.lit(0)), F.col("size")).alias("n")))
    each = mixed.withColumn("_e", F.explode(F.filter(epochs, lambda x: x["n"] > 0)))
    at = (F.col("source_size") * F.col("_e.e") + F.col("_place")).cast("double")
    each = each.withColumn("words_taken", F.col("_e.n")).withColumn("position", position(at, F.col("target"), schedule_of(F.col("source_rank"), schedules))).drop("_e")
    return in_order(back(each), "position")


def in_order(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartitionByRange(F.col(by), F.col("doc_id")).sortWithinPartitions(by, "doc_id")


def mix_light(docs: DataFrame, **options) -> DataFrame:
    """As `mix`, without carrying the text through the shuffles: its digest stands in for it."""
    return mix(docs.withColumn("_w", words()).withColumn("text", F.xxhash64("text")), size=F.col("_w"), **options).drop("_w")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; first_position is where its first word enters training, in parts of 10^9, -1 if it never does."""
    mixed = mix_light(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = position(F.col("_place").cast("double"), F.col("target"), schedule_of(F.col("source_rank")))
    mixed = mixed.withColumn("first_position", F.when(F.col("taken") > 0, F.floor(first * 1e9)).otherwise(F.lit(-1)))
    return in_order(mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position"), "first_position")


#: For tables whose ids are not null: those without one are placed by a hash that DuckDB lacks.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM f WINDOW b AS (ORDER BY fill, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, weight * (SELECT level FROM l WHERE level <= fill ORDER BY fill, level LIMIT 1)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, [1.5, 1.0, 0.5][t.r % 3 + 1]::DOUBLE AS w0, [0.5, 1.0, 1.5][t.r % 3 + 1]::DOUBLE AS w1, CAST(round(t.target) AS BIGINT) AS goal,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(greatest(goal - place, 0), size) + least(greatest(goal - source_size - place, 0), size) + least(greatest(goal - 2 * source_size - place, 0), size) AS BIGINT) AS taken,
  CASE WHEN goal > place AND size > 0 THEN CAST(floor(least(2 * (place / target) / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * (place / target))), 1) * 1e9) AS BIGINT) ELSE -1 END AS first_position
FROM p
"""
