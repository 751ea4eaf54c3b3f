"""Running values over keys of any size, by segments of time.

A running value of a key is taken range by range: rows are cut into ranges of time by quantiles of all rows, a window works
within each range of a key, every range is reduced to a summary of fixed size (sum; streak at its end; last value), and what the
key's earlier ranges leave behind is carried in. Windows over whole keys only see summaries, one for each range, at most a thousand a key. So a key
with half of all rows is worked on by as many tasks as it has ranges.

``order`` holds a time or number and then a number that tells rows of one time apart; ties of time are cut by it too. Rows with a null
time come first. Keys are compared null-safe: null is a key like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.core import in_ranges

RANGE = "__r"


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def segmented(df: DataFrame, time: Column, then: str | None) -> DataFrame:
    """``df`` with the range of time that each row lies in."""
    return in_ranges(df, time, F.col(then) if then else None, RANGE)


def within(keys: Sequence[str], order: Sequence[Column]):
    """The window up to a row within its range of its key."""
    return Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ranges_of(keys: Sequence[str]):
    """The window over the summaries of a key."""
    return Window.partitionBy(*keys, F.lit(0)).orderBy(RANGE)


def carried(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the carry of their range: the summaries are few, a row for each range of a key."""
    same = F.lit(True)
    for k in [*keys, RANGE]:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    more = [c for c in carry.columns if c not in (*keys, RANGE)]
    return rows.alias("x").join(carry.alias("y"), same).select("x.*", *[F.col(f"y.{c}") for c in more])


def running_sum(df: DataFrame, keys: Sequence[str], time: Column, order: Sequence[Column], value: Column, name: str, then: str | None = None) -> DataFrame:
    """``df`` with the sum of a whole number over the key's rows up to each row (W05's cursor is such a sum, modulo the rows)."""
    cut = segmented(df.withColumn("__v", value), time, then)
    sums = cut.groupBy(*keys, RANGE).agg(F.sum("__v").alias("__s"))
    before = sums.withColumn("__s", F.coalesce(F.sum("__s").over(ranges_of(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = cut.withColumn("__own", F.coalesce(F.sum("__v").over(within(keys, order)), F.lit(0)))
    return carried(rows, before, keys).withColumn(name, F.col("__own") + F.col("__s")).drop("__v", "__s", "__own", RANGE)


def streaks(df: DataFrame, keys: Sequence[str], time: Column, order: Sequence[Column], bad: Column, name: str, then: str | None = None) -> DataFrame:
    """``df`` with how many bad rows in a row each row ends, 0 for a good one (W09, W15). A null is good.

    A range leaves behind its own streak at the end if it has a good row, else what it was given plus its length."""
    cut = segmented(df.withColumn("__bad", F.coalesce(bad, F.lit(False)).cast("int")), time, then)
    part = cut.withColumn("__island", F.sum(1 - F.col("__bad")).over(within(keys, order)))
    run = Window.partitionBy(*keys, RANGE, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("__own", F.sum("__bad").over(run))
    # the last island's bad rows are the streak at the end of a range
    islands = part.groupBy(*keys, RANGE, "__island").agg(F.sum("__bad").alias("__n"))
    ends = islands.groupBy(*keys, RANGE).agg(F.max("__island").alias("__good"), F.max_by("__n", "__island").alias("__n"))
    seen = ends.withColumn("__reset", F.sum(F.when(F.col("__good") > 0, 1).otherwise(0)).over(ranges_of(keys).rowsBetween(Window.unboundedPreceding, 0)))
    out = F.sum("__n").over(Window.partitionBy(*keys, "__reset").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0))
    given = seen.withColumn("__out", out).withColumn("__in", F.coalesce(F.lag("__out").over(ranges_of(keys)), F.lit(0))).select(*keys, RANGE, "__in")
    total = F.col("__own") + F.when(F.col("__island") == 0, F.col("__in")).otherwise(F.lit(0))
    return carried(part, given, keys).withColumn(name, total).drop("__bad", "__island", "__own", "__in", RANGE)


def previous(df: DataFrame, keys: Sequence[str], time: Column, order: Sequence[Column], value: Column, name: str, then: str | None = None) -> DataFrame:
    """``df`` with a struct ``name`` (value) of the key's row before, null for the first one."""
    cut = segmented(df.withColumn("__v", F.struct(value.alias("value"))), time, then)
    at = Window.partitionBy(*keys, RANGE).orderBy(*order)
    rows = cut.withColumns({"__before": F.lag("__v").over(at), "__last": F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*[_turned(o) for o in order]))})
    ends = rows.filter("__last = 1").select(*keys, RANGE, F.col("__v").alias("__end"))
    given = ends.withColumn("__given", F.lag("__end").over(ranges_of(keys))).drop("__end")
    return carried(rows, given, keys).withColumn(name, F.coalesce("__before", "__given")).drop("__v", "__before", "__last", "__given", RANGE)


def _turned(c: Column) -> Column:
    """The other way round: nulls, which come first in ascending order, last."""
    return c.desc_nulls_last()


def trailing_counts(df: DataFrame, keys: Sequence[str], time: Column, width: int, name: str) -> DataFrame:
    """``df`` with how many of the key's rows lie within ``width`` before each row's time, it and all of its time included.

    Rows of one time are one row with their number; each adds to a running sum at its time and takes off just after time plus width."""
    timed = df.withColumn("__t", time)
    moments = timed.filter("__t is not null").groupBy(*keys, "__t").agg(F.count("*").alias("__n"))
    both = moments.select(*keys, "__t", F.lit(0).alias("__phase"), "__n").unionByName(moments.select(*keys, (F.col("__t") + width).alias("__t"), F.lit(1).alias("__phase"), (-F.col("__n")).alias("__n")))
    held = running_sum(both, keys, F.col("__t"), [F.col("__t"), F.col("__phase")], F.col("__n"), "__held").filter("__phase = 0")
    same = F.col("x.__t") == F.col("y.__t")
    for k in keys:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return timed.alias("x").join(held.alias("y"), same, "left").select("x.*", F.col("y.__held").alias(name)).drop("__t")
