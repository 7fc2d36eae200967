"""Sinks: CSV, JSON lines, staged overwrites, appended checkpoints, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources.readers import exists


#: A header, quotes doubled, white space at either end of a value kept.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled, columns in the given order."""
    df = df.select(*columns) if columns else df
    df.write.mode(mode).options(**CSV).csv(path)


def staged_overwrite(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Replace the table at path by df, which may read that very table: written beside it first, then put in its place by
    renames. A failure while writing leaves the old table as it was; one between the renames leaves it under path + '.old-...'."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    new, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    w = df.write.format(fmt).options(**options)
    (w.options(**CSV) if fmt == "csv" else w).save(new)
    jvm = spark.sparkContext._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = exists(spark, path)
    if had and not fs.rename(p(path), p(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(p(new), p(path)):
        if had:
            fs.rename(p(old), p(path))
        raise OSError(f"can't move {new}")
    if had:
        fs.delete(p(old), True)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add the rows of one batch to a growing table."""
    w = df.write.mode("append").format(fmt)
    (w.options(**CSV) if fmt == "csv" else w).save(path)


def json_line(record: Column) -> Column:
    """One JSON object as text, null fields included."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, record: Column, path: str, split: str | None = None) -> None:
    """JSON lines; with `split`, one folder for each value of that column, from a single pass."""
    out = df.select(*([F.col(split)] if split else []), json_line(record).alias("value"))
    w = out.write.mode("overwrite")
    (w.partitionBy(split) if split else w).text(path)


def report(df: DataFrame, n: int = 20, width: int | None = None) -> str:
    """The first n rows as a text table; width None leaves long values whole."""
    return df._jdf.showString(n, width or 0, False)
