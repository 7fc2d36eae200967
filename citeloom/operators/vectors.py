"""Document vectors: sentences, weighted means, exact inner-product search, an index that grows by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.functions.text import strip
from citeloom.operators.prefix import with_position
from citeloom.sources.readers import read_or_empty
from citeloom.sources.sinks import append

QUERY_BLOCK = 2_048  # queries that are compared with the whole index at once


def sentences(text: Column) -> Column:
    """Pieces between full stops followed by a blank, white space off, empty ones left out; the whole text where none is left."""
    parts = F.filter(F.transform(F.split(text, r"\. "), lambda s: strip(s)), lambda s: s != "")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v over its length as doubles; a vector of zeros stays."""
    n = norm(v)
    d = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(v, lambda x: x.cast("double") / d)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def summary(df: DataFrame, vector: str) -> DataFrame:
    """(n_vectors, dim_min, dim_max, norm_min, norm_max)."""
    return df.agg(F.count(vector).alias("n_vectors"), F.min(F.size(vector)).alias("dim_min"), F.max(F.size(vector)).alias("dim_max"), F.min(norm(F.col(vector))).alias("norm_min"), F.max(norm(F.col(vector))).alias("norm_max"))


def weighted_mean(df: DataFrame, key: str, vector: str, weight: Column, normalize: bool = True) -> DataFrame:
    """(key, vec): mean of the key's vectors by weight (at least 1), then of length one. Sums of each dimension are combined in
    the tasks, so a key that holds a third of all rows sends one row of sums per task."""
    rows = df.select(F.col(key).alias("key"), F.greatest(weight.cast("double"), F.lit(1.0)).alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = rows.groupBy("key", "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    out = sums.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return out.select(F.col("key").alias(key), (l2_normalize(F.col("v")) if normalize else F.col("v")).alias("vec"))


def top_k(index: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, neighbour_id, score): exact inner-product search, ties to the smaller id.

    The stated queries go to the index in blocks of QUERY_BLOCK, which bounds what is broadcast; every task keeps k rows for each
    query of what it sees and only those are merged. Nulls have no score; vectors of other lengths than the query's neither.
    """
    from pyspark.sql import Window

    spark = index.sparkSession
    kind = index.schema[id_col].dataType.simpleString()
    src = index.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    out = None

    def searched(rows: list) -> DataFrame:
        q = spark.sparkContext.broadcast((np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], np.float64)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = q.value
            best: pd.DataFrame | None = None
            for f in frames:
                ok = np.array([len(v) == m.shape[1] for v in f["v"]], bool)
                f = f[ok]
                if not len(f):
                    continue
                x, xid = np.stack(list(f["v"])).astype(np.float64), f["id"].to_numpy()
                s = np.round(m @ x.T, 9)
                if skip_self:
                    s[ids[:, None] == xid[None, :]] = -np.inf
                if s.shape[1] > k:  # all that reach the k-th best score of a query, ties included
                    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    row, col = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
                else:
                    row, col = np.nonzero(np.isfinite(s))
                got = pd.DataFrame({"query_id": ids[row], "neighbour_id": xid[col], "score": s[row, col]})
                best = got if best is None else pd.concat([best, got])
                best = best.sort_values(["query_id", "score", "neighbour_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        return src.mapInPandas(run, f"query_id {kind}, neighbour_id {kind}, score double")

    block: list = []
    dim = None
    for r in queries.where(F.col(vector).isNotNull()).select(id_col, vector).toLocalIterator():
        if dim not in (None, len(r[1])) or len(block) == QUERY_BLOCK:
            out, block = (searched(block) if out is None else out.unionByName(searched(block))), []
        dim = len(r[1])
        block.append(r)
    if block:
        out = searched(block) if out is None else out.unionByName(searched(block))
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, neighbour_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "score")


def self_retrieval(index: DataFrame, queries: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, ok): whether a query's best score equals that with itself; by score, as equal vectors tie."""
    best = top_k(index, queries, id_col, vector, 1)
    own = queries.select(F.col(id_col).alias("query_id"), inner_product(F.col(vector), F.col(vector)).alias("own"))
    return best.join(own, "query_id").select(F.col("query_id").alias("id"), (F.abs(F.col("score") - F.col("own")) < 1e-5).alias("ok"))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashes of words, summed."""
    import hashlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return encode


def embed(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "vec") -> DataFrame:
    """df with a vector of each text; `make` builds the encoder once in each Python worker. Null texts have a null vector."""

    @F.pandas_udf("array<float>")
    def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in batches:
            got = encode([t if isinstance(t, str) else "" for t in s])
            yield pd.Series([g if isinstance(t, str) else None for g, t in zip(got, s)])

    return df.withColumn(out, vec(F.col(text)))


def letters_embedder() -> Callable[[list[str]], np.ndarray]:
    """Another stand-in for a model, which SQL can check: how often each of the letters a to z stands in a text."""

    def encode(texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in low], np.float32).reshape(len(texts), 26)

    return encode


def sentence_index(docs: DataFrame, id_col: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, sent_no, sentence, vec): the sentences of each document, numbered from 0, with vectors of length one; to be kept as a
    table, in which a document's sentences are searched by a filter on its id. Null texts have none."""
    s = docs.where(F.col(text).isNotNull()).select(F.col(id_col), F.posexplode(sentences(F.col(text))).alias("sent_no", "sentence"))
    return embed(s, "sentence", make).withColumn("vec", l2_normalize(F.col("vec")))


def document_vectors(docs: DataFrame, id_col: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, vec): mean of the sentences' vectors, each of length one, weighted by the sentence's length. Null texts have none."""
    return weighted_mean(sentence_index(docs, id_col, text, make), id_col, "vec", F.length("sentence"))


def extend_index(docs: DataFrame, path: str, schema: StructType, id_col: str, build: Callable[[DataFrame], DataFrame], order: str, batch: int = 10_000, pos: str | None = None) -> int:
    """Add the next `batch` documents by `order` that the index at path lacks; returns how many were added. Running it again
    goes on; when nothing is left it returns 0. pos: a column that gets each row's number in the index, from 0."""
    spark = docs.sparkSession
    old = read_or_empty(spark, path, schema)
    done = old.select(F.col(id_col).alias("__done")).distinct()
    todo = docs.join(done, docs[id_col] == F.col("__done"), "left_anti").dropDuplicates([id_col]).orderBy(order).limit(batch)
    new = build(todo)
    if pos:
        before = old.count()
        new = with_position(new, [F.col(id_col)], pos).withColumn(pos, F.col(pos) + before)
    new = new.select(*schema.fieldNames()).cache()
    n = new.count()
    if n:
        append(new, path)
    new.unpersist()
    return n
