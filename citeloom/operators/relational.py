"""Relational helpers whose order, ties and nulls are defined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.prefix import with_position


def distinct_on(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row for each combination of keys (nulls equal each other): the first or last by `order`, which must be total. By
    partial aggregation of the greatest row, so a frequent key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(1)
    out = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def same_columns(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both have the same set of columns, in whatever order."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")


def with_constants(df: DataFrame, **values: str | int | None) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    """All pairs are equal, null and null included."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def semi(df: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of df whose keys stand in other; null keys stand nowhere."""
    o = other.select(*[F.col(v).alias(f"__{v}") for v in on.values()])
    return df.join(o, [df[k] == o[f"__{v}"] for k, v in on.items()], "left_semi")


def anti(df: DataFrame, other: DataFrame, on: dict[str, str], nulls_match: bool = False) -> DataFrame:
    """Rows of df whose keys don't stand in other. Rows with a null key are kept, unless nulls_match and other has a null too."""
    o = other.select(*[F.col(v).alias(f"__{v}") for v in on.values()])
    cond = [(df[k].eqNullSafe(o[f"__{v}"]) if nulls_match else df[k] == o[f"__{v}"]) for k, v in on.items()]
    return df.join(o, cond, "left_anti")


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(side, n_rows, n_in_other): how many rows of each table have a key that stands in the other."""
    def one(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        keys = y.select(F.col(on).alias("__k"), F.lit(1).alias("__in")).where("__k IS NOT NULL").distinct()
        return x.join(keys, x[on] == keys["__k"], "left").agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n_rows"), F.count("__in").alias("n_in_other"))

    return one(a, b, "left").unionByName(one(b, a, "right"))


def lookup_one(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of each key's first row by `order`."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def lookup_strict(df: DataFrame, key: str, value: str, order: str, wanted: str):
    """The value of one key's first row; a key that isn't there raises."""
    r = df.where(F.col(key) == wanted).orderBy(order).select(value).head()
    if r is None:
        raise KeyError(wanted)
    return r[0]


def count_values(df: DataFrame, column: str) -> DataFrame:
    """(n_values): distinct values, null counting as one."""
    return df.agg((F.count_distinct(column) + F.max(F.col(column).isNull().cast("bigint"))).alias("n_values")).select(F.coalesce("n_values", F.lit(0)).alias("n_values"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by a total order; each task keeps n rows at most."""
    return df.orderBy(*order).limit(n)


def last_of_first(df: DataFrame, order: list[Column], head: int, tail: int) -> DataFrame:
    """The last `tail` of the first `head` rows by a total order, with their rank: ranks 31-50 of head 50, tail 20. Of fewer rows
    the last ones that there are."""
    ranked = top(df, order, head).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.where(F.col("rank") > n - tail)


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """Rows of two tables side by side by their places in their orders, as far as the shorter one goes; columns' names must differ."""
    if clash := set(a.columns) & set(b.columns):
        raise ValueError(f"in both tables: {sorted(clash)}")
    x, y = with_position(a, order_a, "__a"), with_position(b, order_b, "__b")
    return x.join(y, x["__a"] == y["__b"]).drop("__a", "__b")
