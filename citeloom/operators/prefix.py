"""Running sums over groups and positions in an order, of any size, without one task per group or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import materialize


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, bucket: Column, out: str, buckets_known: int) -> DataFrame:
    """df with `out`: the sum of `value` over the earlier rows of the group, the row itself not included.

    bucket: an integer below `buckets_known` that doesn't fall along `order`; rows of a group are summed bucket by bucket, each in
    a task's sort of its own, and the buckets' totals (at most groups x buckets_known rows) are summed in a second, small step.
    So a group that holds a third of all rows is spread over all of its buckets. Null values count 0.
    """
    b, v = "__bucket", "__value"
    rows = df.withColumn(b, bucket).withColumn(v, F.coalesce(value, F.lit(0)))
    inner = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, b).agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    totals = totals.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col(b).alias("__b"), "__before")
    match = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group] + [F.col(b) == F.col("__b")]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    joined = rows.join(totals, cond).withColumn(out, F.col("__before") + F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return joined.drop(b, v, "__before", "__b", *[f"__g_{g}" for g in group])


def with_position(df: DataFrame, order: list[Column], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """df with `out`: the place of each row, from 0, in a total order; ties get places in no stated order.

    Ranges of the order are sorted in a task each and numbered there; the sizes of the ranges (one row a task) give each range its
    first place. So neither the table nor a value that a third of its rows share is sorted in one task. The numbered rows are
    written once, as ranges drawn a second time could differ. An empty table has no rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    numbered = materialize(numbered, "places")
    sizes = numbered.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__first"))
    joined = numbered.join(F.broadcast(first), F.shiftright("__at", 33) == F.col("__range"))  # one row for each task
    return joined.withColumn(out, F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__range", "__first")
