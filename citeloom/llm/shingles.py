"""Sets of word sequences, and links between classes of equal sets."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+")
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))
CHUNK = 1_024  # members of a class that meet those of another in one cell, on average
HOT_CLASSES = 10_000  # classes that hold more than 1 / HOT_CLASSES of all rows are fewer than this
ID_BUCKETS = 1 << 18  # hash classes of ids; so many rows are broadcast at most to leave out texts that no candidate names


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def gram_hashes(texts: Iterable[str], n: int, known: WordHashes) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-word sequences; all texts are hashed in one go."""
    words = [WORD.findall(t.lower()) for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(size.sum()))
    if len(h) < n:
        return [np.empty(0, np.uint64)] * len(words)
    g = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            g += h[k : len(h) - n + 1 + k] * _MUL[k % 5]
            g ^= g >> np.uint64(33)
            g *= _MUL[(k + 1) % 5]
            g ^= g >> np.uint64(29)
    begin = np.cumsum(size) - size
    out = []
    for lo, m in zip(begin.tolist(), size.tolist()):
        own = np.sort(g[lo : lo + m - n + 1]) if m >= n else np.empty(0, np.uint64)
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def _shingled(f: pd.DataFrame, n: int, known: WordHashes) -> Iterator[tuple]:
    """(id, grams) of the texts that have sequences."""
    return ((i, g) for i, g in zip(f["id"], gram_hashes(f["text"], n, known)) if len(g))


def texts_of(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, text) of the rows that have both."""
    return df.select(F.col(id_col).alias("id"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def shingle_sets(texts: DataFrame, n: int = 3) -> DataFrame:
    """(id, grams): the distinct n-word sequences of texts (id, text) as sorted 64-bit hashes.

    Words are runs of a-z0-9 after lower-casing. Texts under n words have no sequences and no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for f in frames:
            if len(known) > 1_000_000:
                known.clear()
            yield pd.DataFrame([(i, g.view(np.int64)) for i, g in _shingled(f, n, known)], columns=["id", "grams"])

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, grams array<bigint>")


def set_names(texts: DataFrame, n: int = 3, extra=None, fields: str = "") -> DataFrame:
    """(id, h1, h2, size, ...): of each text with sequences two hashes that tell equal sets, and their number; the sequences
    themselves aren't kept. extra(grams) gives the values of further `fields`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        names = ["id", "h1", "h2", "size", *[x.split()[0] for x in fields.split(", ") if x]]
        for f in frames:
            if len(known) > 1_000_000:
                known.clear()
            rows = []
            for i, g in _shingled(f, n, known):
                d = xxhash.xxh3_128(g.tobytes()).intdigest()
                rows.append((i, (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63, len(g), *(extra(g) if extra else ())))
            yield pd.DataFrame(rows, columns=names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, h1 bigint, h2 bigint, size int" + (f", {fields}" if fields else ""))


def classes(sets: DataFrame, id_col: str = "id") -> DataFrame:
    """(h1, h2, rep, copies): classes of equal sets; rep is the least id."""
    return sets.groupBy("h1", "h2").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))


def join_classes(rows: DataFrame, of: DataFrame, keys: list[str], copies: str = "copies") -> DataFrame:
    """rows joined with their classes (one row for each key, `copies` members). Classes of more than a HOT_CLASSES-th of all rows
    are fewer than HOT_CLASSES and broadcast, so their rows stay where they are; the others are joined by key."""
    total = rows.count()
    most = max(1_000, total // HOT_CLASSES)
    hot = F.broadcast(of.where(F.col(copies) > most))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(of.where(F.col(copies) <= most), keys))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id stands in ids (id), and few others: those of the same hash class. What is broadcast are ID_BUCKETS numbers at
    most, so rows that nobody asks for are left out before any shuffle."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS)).cast("int")
    asked = F.broadcast(ids.select(bucket("id").alias("__bucket")).distinct())
    return rows.withColumn("__bucket", bucket("id")).join(asked, "__bucket", "left_semi").drop("__bucket")


def jaccard_at_least(pairs: DataFrame, texts: DataFrame, a: str, b: str, least: float, n: int) -> DataFrame:
    """The pairs (a, b of the texts' ids) whose sets share at least `least` of their union, with `similarity`; exact. The sets are
    built again, for the texts in question alone, and travel once to either end."""
    ids = pairs.select(F.explode(F.array(a, b)).alias("id")).distinct()
    sets = shingle_sets(only(texts, ids), n)
    one = sets.select(F.col("id").alias(a), F.col("grams").alias("__ga"))
    two = sets.select(F.col("id").alias(b), F.col("grams").alias("__gb"))
    j = pairs.join(one, a).join(two, b).withColumn("__both", F.size(F.array_intersect("__ga", "__gb")))
    j = j.withColumn("similarity", F.col("__both") / (F.size("__ga") + F.size("__gb") - F.col("__both")))
    return j.where(F.col("similarity") >= least).drop("__ga", "__gb", "__both")


def expand(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y) of links (a, b) between classes: every member of a with every member of b.

    left, right: class, member, n: each member with its class and the class's size on this side. Members are dealt out to chunks
    of CHUNK; chunks of two classes meet in cells, so no task holds the product of two large classes.
    """

    def dealt(side: DataFrame, key: str, member: str) -> tuple[DataFrame, DataFrame]:
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        rows = side.select(F.col("class").alias(key), F.col("member").alias(member), F.pmod(F.xxhash64("member"), chunks).cast("int").alias(f"c{key}"))
        sizes = side.groupBy(F.col("class").alias(key)).agg(F.max(chunks).alias(f"n{key}"))
        return rows, sizes

    (lm, ls), (rm, rs) = dealt(left, "a", "x"), dealt(right, "b", "y")
    cells = links.select("a", "b").join(ls, "a").join(rs, "b")
    cells = cells.withColumn("ca", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return cells.select("a", "b", "ca", "cb").join(lm, ["a", "ca"]).join(rm, ["b", "cb"]).select("x", "y")
