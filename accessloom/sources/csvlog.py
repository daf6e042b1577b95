"""Reading raw seven-field logs: exact field rules, replacement of bad values, and quality counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import EVENTS, LOCATIONS, PREFIXES, UNKNOWN, fits_uint64, valid_id

COUNTERS = ("totalRead", "skipped", "replaced", "outOfRange")
_ROW_BITS = 33


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with `pos`, which grows with a line's place in the file.

    Lines end at \\n only. A task reads one split; a line's place is its split's first byte plus its number in the split,
    which stays below the split's length. The header (place 0) and empty lines aren't there.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.withColumn("pos", F.col("_from") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1))
    return lines.select(F.regexp_replace("value", "\r$", "").alias("value"), "pos").where((F.col("pos") > 0) & (F.col("value") != ""))


def parsed(lines: DataFrame) -> DataFrame:
    """Every line with its fields as they are kept, and whether it is accepted, counted as replaced, or out of range.

    Fields are what stands between commas: no quotes, no trimming. Other than seven fields, or a timestamp that is
    no unsigned 64-bit number, skips the line. Bad ids, events and locations are replaced, and a line with any counts once.
    Timestamps from 2^63 are beyond a bigint: such lines are skipped and counted apart.
    """
    f = F.split(F.col("value"), ",", -1)
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    kept: dict[str, Column] = {}
    bad: list[Column] = []
    for i, (kind, prefix) in enumerate(PREFIXES.items()):
        good = valid_id(at(i), prefix)
        kept[kind] = F.when(good, at(i)).otherwise(f"{UNKNOWN}_{kind.upper()}")
        bad.append(~good)
    for i, name, values in ((4, "event_type", EVENTS), (5, "location", LOCATIONS)):
        kept[name] = F.when(at(i).isin(*values), at(i)).otherwise(UNKNOWN)
        bad.append(~at(i).isin(*values))
    number = fits_uint64(at(6))
    seconds = F.when(number, at(6)).try_cast("decimal(20,0)").try_cast("bigint")
    whole = F.size(f) == 7
    return lines.select(
        *[c.alias(n) for n, c in kept.items()],
        seconds.alias("timestamp"),
        "pos",
        (whole & number & seconds.isNotNull()).alias("accepted"),
        (whole & number & F.array_contains(F.array(*bad), True)).alias("replaced"),
        (whole & number & seconds.isNull()).alias("beyond"),
    )


def counters(rows: DataFrame) -> list[Column]:
    number = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [F.count("*").alias("totalRead"), number(~F.col("accepted")).alias("skipped"), number(F.col("replaced") & F.col("accepted")).alias("replaced"), number(F.col("beyond")).alias("outOfRange")]
