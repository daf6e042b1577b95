"""Window building blocks of the detectors: positions, islands, crossings, and sliding windows as sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .values import ORDER


#: The last moment that a timestamp can name.
LAST = (1 << 63) - 1


def over(key: str, *more: str) -> WindowSpec:
    return Window.partitionBy(key, *more).orderBy(*ORDER)


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_seq(recs: DataFrame, key: str) -> DataFrame:
    """Adds seq, a row's position among those of its key in the log's total order."""
    return recs.withColumn("seq", F.row_number().over(over(key)).cast("long"))


def by_seq(key: str, *more: str) -> WindowSpec:
    return Window.partitionBy(key, *more).orderBy("seq")


def island(key: str, starts: Column) -> Column:
    """Number of rows so far that start a new stretch."""
    return F.sum(starts.cast("long")).over(upto(by_seq(key)))


def crossing(holds: Column, spec: WindowSpec) -> Column:
    """Whether a condition holds at a row and didn't at the one before."""
    return holds & ~F.coalesce(F.lag(holds).over(spec), F.lit(False))


def sliding(rows: DataFrame, key: str, width: int, sums: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """Adds sums, and numbers of distinct values, over each row's window [timestamp - width, timestamp] up to the row itself.

    A sweep over time: every row counts from itself on and stops counting just after its window's end, so a running sum
    over starts and ends gives each row's value. For distinct values a row starts only once the previous row
    of its value is out of the window. Rows of one time that come later in order aren't seen, and the work is a sort, however
    many rows a window holds. What would end beyond the last moment there is never ends.
    """
    distinct = distinct or {}
    for name, value in distinct.items():
        rows = rows.withColumn(f"_before_{name}", F.lag("timestamp").over(by_seq(key, value)))
    names = [*sums, *distinct]
    out = F.lit(width + 1).cast("long")
    ended = F.try_add(F.col("timestamp"), out)
    now = F.col("timestamp")
    # When the previous row of a value is out; null if it never is, which only ends after the last row can tell.
    freed = {n: F.when(F.col(f"_before_{n}").isNull(), now).otherwise(F.try_add(F.col(f"_before_{n}"), out)) for n in distinct}
    starts = {n: now for n in sums} | {n: F.greatest(now, F.coalesce(freed[n], F.lit(LAST))) for n in distinct}
    lasts = {n: F.lit(False) for n in sums} | {n: freed[n].isNull() for n in distinct}
    amount = {n: c.cast("long") for n, c in sums.items()} | {n: F.lit(1).cast("long") for n in distinct}
    zero = F.lit(0).cast("long")
    kept = [c for c in rows.columns if not c.startswith("_before_")]
    payload = F.struct(*[F.col(c) for c in kept])

    def event(at: Column, phase: Column | int, row: Column, values: dict[str, Column]) -> Column:
        return F.struct(at.cast("long").alias("_at"), (F.lit(phase) if isinstance(phase, int) else phase).alias("_phase"), row.alias("_row"), *[values.get(n, zero).alias(f"_{n}") for n in names])

    nothing = F.lit(None).cast(rows.select(payload.alias("p")).schema["p"].dataType)
    own = event(now, 1, payload, {n: F.when((starts[n] == now) & ~lasts[n], amount[n]).otherwise(zero) for n in names})
    ends = F.coalesce(ended, F.lit(LAST))
    end = event(ends, F.when(ended.isNull(), 2).otherwise(0), nothing, {n: F.when((starts[n] < ends) & ~lasts[n] & ended.isNotNull(), -amount[n]).otherwise(zero) for n in names})
    late = [event(starts[n], 0, nothing, {n: F.when((starts[n] > now) & ~lasts[n] & ((starts[n] < ends) | ended.isNull()), amount[n]).otherwise(zero)}) for n in distinct]
    sweep = Window.partitionBy(key).orderBy("_at", "_phase", "_row.seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.select(key, F.explode(F.array(own, end, *late)).alias("_e")).select(key, "_e.*")
    swept = swept.select("_row", *[F.sum(f"_{n}").over(sweep).alias(n) for n in names]).where(F.col("_row").isNotNull())
    return swept.select("_row.*", *names)
