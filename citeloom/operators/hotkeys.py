"""Results per key where a few keys hold most rows.

Every result is made from mergeable states: each task combines its rows in a bounded hash table (Spark's partial aggregation,
which spills by sorting), and only one compact state per key and task is shuffled. No row is shuffled, so a key that holds a
third of all rows costs the reducing task one state per map task, as any other key does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: dict[str, Column], aggs: dict[str, Column], keep_null_keys: bool = True) -> DataFrame:
    """groupBy(keys).agg(aggs) for algebraic aggregates (count, sum, min, max, avg, moments, sketches, max_by ...).

    Null keys form one group, or are dropped with keep_null_keys=False. An empty table gives no rows. Other columns are never read.
    Aggregates that hold all values of a group (collect_list, exact percentile) are refused: their states aren't compact.
    """
    for name, a in aggs.items():
        text = str(a).lower()
        if any(bad in text for bad in ("collect_list", "collect_set", "percentile(", "median", "listagg", "string_agg", "array_agg", "mode(")):
            raise ValueError(f"{name}: the state of this aggregate grows with the key's rows")
    rows = df
    if not keep_null_keys:
        for k in keys.values():
            rows = rows.where(k.isNotNull())
    return rows.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(*[a.alias(n) for n, a in aggs.items()])


def counts_by_field(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(key_field, key_value, n_rows) for each field and value, null values included, in one scan."""
    entries = F.inline(F.array(*[F.struct(F.lit(n).alias("key_field"), k.alias("key_value")) for n, k in fields.items()]))
    return df.select(entries).groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("n_rows"))


def hot_keys(df: DataFrame, fields: dict[str, Column], share: float = 0.03) -> DataFrame:
    """(key_field, key_value, n_rows, row_share) of the keys that hold at least `share` of all rows of df.

    Null keys count in the total but are no key. An empty table gives no rows.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = counts_by_field(df, fields).where(F.col("key_value").isNotNull())
    return c.withColumn("row_share", F.col("n_rows") / total).where(F.col("row_share") >= share)
