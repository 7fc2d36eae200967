"""Sources: CSV with multi-line texts, lines, Parquet, literal rows, ranges, settings, and pages fetched over HTTP."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from citeloom.functions.text import csv_null
from citeloom.sources.schemas import texts


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, columns: list[str] | StructType | None = None, nulls: bool = True) -> DataFrame:
    """A CSV file or folder with a header; quoted fields may span lines, quotes inside are doubled. With columns, the typed schema
    (all strings from a list of names); without, strings under the header's names. The usual spellings of a missing value become
    null unless nulls=False. A file is one split, as a quoted line break can't be told from a record's end inside it; write large
    tables as many files or, better, as Parquet."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    if columns is not None:
        r = r.schema(columns if isinstance(columns, StructType) else texts(columns))
    df = r.csv(path)
    return df.select(*[(csv_null(c) if t == "string" and nulls else F.col(c)).alias(c) for c, t in df.dtypes])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each line of UTF-8 text files."""
    return spark.read.text(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The table at path, or an empty one of the schema where nothing is there (a first run)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)


def literal(spark: SparkSession, rows: Iterable, schema: StructType | str) -> DataFrame:
    """A table of given rows."""
    return spark.createDataFrame(list(rows), schema)


def numbers(spark: SparkSession, first: int, last: int, name: str = "year") -> DataFrame:
    """One row for each whole number from first to last, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def page_urls(spark: SparkSession, base: str, pages: int) -> DataFrame:
    """(page, url): base?page=0 ... of a list with a fixed number of pages."""
    return spark.range(pages).select(F.col("id").cast("int").alias("page"), F.format_string(base + "?page=%d", F.col("id")).alias("url"))


def settings(prefix: str, defaults: dict[str, str]) -> dict[str, str]:
    """Values of the environment's variables prefix + NAME, else the defaults."""
    return {k: os.environ.get(prefix + k.upper(), v) for k, v in defaults.items()}


def fetch(url: str, timeout: float = 30.0, agent: str = "citeloom/0.1") -> str:
    """Text of an address; an HTTP status of 400 or more raises."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _PageReader(DataSourceReader):
    def __init__(self, options: dict, get: Callable[[str], str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.parts = max(1, min(int(options.get("partitions", "8")), len(self.urls) or 1))
        self.timeout, self.get = float(options.get("timeout", "30")), get

    def partitions(self) -> list[_Part]:
        return [_Part(self.urls[k :: self.parts]) for k in range(self.parts)]

    def read(self, partition: _Part):
        for u in partition.urls:
            try:
                yield u, True, None, self.get(u)
            except Exception as e:  # one page's failure is a row, not the end of the run
                yield u, False, f"{type(e).__name__}: {e}"[:500], None


class Pages(DataSource):
    """spark.read.format("pages").option("urls", "\\n".join(urls)).load() -> url, ok, error, html; failures are rows."""

    get: Callable[[str], str] = staticmethod(fetch)

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, ok boolean, error string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.options, type(self).get)


def register_pages(spark: SparkSession, get: Callable[[str], str] | None = None) -> None:
    """Make the format "pages" known; `get` replaces the HTTP call (a browser, a cache, a test)."""
    source = Pages if get is None else type("Pages", (Pages,), {"get": staticmethod(get)})
    spark.dataSource.register(source)
