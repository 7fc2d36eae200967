"""Problem 4: near-duplicate records by a chosen-path join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.shingles import HOT_CLASSES, classes, expand, jaccard_at_least, join_classes, mix64, only, set_names, shingle_sets, texts_of
from citeloom.operators.components import connected_components
from citeloom.runtime import materialize, table

TOKENS = 128  # sampled tokens (minhashes) that stand for a set
BUCKET = 400  # records of a bucket that are compared with each other
MAX_DEPTH = 6
TARGET_RECALL = 0.99


@lru_cache(1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, TOKENS, np.uint64) | np.uint64(1), r.integers(0, 2**63, TOKENS, np.uint64)


def sampled_tokens(grams: np.ndarray) -> np.ndarray:
    """For each of TOKENS random orders the first token of the set, as 32 bits; two sets agree in one with the probability of
    their Jaccard similarity."""
    a, b = _seeds()
    with np.errstate(over="ignore"):
        h = mix64(grams.view(np.uint64)[:, None] * a[None, :] + b[None, :])
    return (h.min(0) >> np.uint64(32)).astype(np.uint32)


def survival(least: float, depth: int) -> float:
    """Probability that a pair of similarity `least` stays together down to `depth` in one run."""
    p, extra = 1.0, 1 / least - int(1 / least)
    for _ in range(depth):
        q = 1 - least * p
        p = 1 - q ** int(1 / least) * (1 - extra * least * p)
    return p


def runs_for(least: float, recall: float = TARGET_RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs after which a pair of similarity `least` met in some bucket with probability `recall`, were all buckets `depth` deep."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(least, depth)))


def _children(path: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sampled tokens of each node: (row of path, token position). A node takes 1 / least tokens on average, the same for all
    records in it, so that a pair of that similarity keeps one shared child on average."""
    whole, extra = int(1 / least), 1 / least - int(1 / least)
    rows, tokens = [], []
    for k in range(whole + 1):
        with np.errstate(over="ignore"):
            h = mix64(path + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        go = np.ones(len(path), bool) if k < whole else (h >> np.uint64(40)).astype(float) / 2**24 < extra
        rows.append(np.flatnonzero(go))
        tokens.append((h[go] % np.uint64(TOKENS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(tokens)


def _step(path: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(path * np.uint64(31) + token.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + value.astype(np.uint64))


def sketch(sig: np.ndarray) -> tuple[int, int]:
    """One bit of each sampled token, 128 in all: two sets of similarity s agree in (1 + s) / 2 of them."""
    return tuple(np.packbits((sig & 1).astype(np.uint8)).view(np.int64).tolist())


def _roots(runs: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(path, token) of each node of the first level of all runs."""
    roots = mix64(np.arange(1, runs + 1, dtype=np.uint64))
    row, token = _children(roots, least)
    return roots[row], token


def _buckets(frames: Iterator[pd.DataFrame], bits: int, bucket: int) -> Iterator[pd.DataFrame]:
    """Pairs of each run of equal paths of at most `bucket` rows whose sketches agree in `bits` or more, as (a, b, null); rows of
    longer runs come back as (id, null, path). The frames come sorted by path; of a run no more than a bucket is held."""
    held = {k: [] for k in ("path", "id", "s1", "s2")}
    over = None  # the path of a run that turned out too long

    def compare(path: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> pd.DataFrame:
        cut = np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path))
        size = np.diff(cut)
        left = np.repeat(cut[1:], size) - np.arange(len(path)) - 1  # rows of the run behind each row
        long_ = np.repeat(size > bucket, size)
        left[long_] = 0
        a, b, at, step = [], [], np.flatnonzero(left), 1
        while len(at):  # each row with the first behind it, then with the second ...
            same = TOKENS - np.bitwise_count(sk[at] ^ sk[at + step]).sum(1).astype(int)
            hit = at[same >= bits]
            a.append(ids[hit])
            b.append(ids[hit + step])
            step += 1
            at = at[left[at] >= step]
        x = np.concatenate(a) if a else np.empty(0, ids.dtype)
        y = np.concatenate(b) if b else np.empty(0, ids.dtype)
        out = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).astype(object)
        out = out[out["a"] != out["b"]].drop_duplicates().assign(path=None)
        return pd.concat([out, pd.DataFrame({"a": ids[long_].astype(object), "b": None, "path": path[long_].astype(object)})], ignore_index=True)

    def flush() -> pd.DataFrame | None:
        if not held["path"]:
            return None
        path, ids, s1, s2 = (np.concatenate(held[k]) for k in ("path", "id", "s1", "s2"))
        for v in held.values():
            v.clear()
        return compare(path, ids, np.stack([s1, s2], 1).view(np.uint64))

    for f in frames:
        if not len(f):
            continue
        if over is not None:
            same = f["path"].to_numpy() == over
            if same.any():
                yield pd.DataFrame({"a": f["id"][same].astype(object), "b": None, "path": over})
                f = f[~same]
            if not len(f):
                continue
            over = None
        path = f["path"].to_numpy()
        last = path == path[-1]
        whole = f[~last]
        for part, end in ((whole, True), (f[last], False)):
            if not len(part):
                continue
            if held["path"] and part["path"].iloc[0] != held["path"][-1][-1] and not end:
                if (x := flush()) is not None:
                    yield x
            for k, v in held.items():
                v.append(part[k].to_numpy())
            if end and (x := flush()) is not None:
                yield x
        if sum(map(len, held["path"])) > bucket:
            over = path[-1]
            if (x := flush()) is not None:
                yield x
    if (x := flush()) is not None:
        yield x


def candidate_pairs(signed: DataFrame, texts: DataFrame, least: float, n: int, runs: int, bucket: int = BUCKET, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(a, b), a < b: records that met in a bucket and whose sketches agree nearly as often as those of similarity `least`.

    signed: id, s1, s2, paths, of distinct sets; texts: id, text. Each run splits all records by the values of a few sampled tokens;
    buckets of 2 to `bucket` records are compared, larger ones are split again on tokens sampled for them alone. A bucket still too
    large at max_depth holds texts alike in nearly everything: it is cut into blocks of which every two are compared, as nearly
    every two of them are a link, so none is dropped. What travels of a record is its number, its path and 128 bits; records of
    paths that are frequent over the whole table (fewer than HOT_CLASSES per run) aren't brought together at all before they split.
    """
    spark = signed.sparkSession
    kind = signed.schema["id"].dataType.simpleString()
    # of a pair of similarity `least` (1 + least) / 2 of the bits agree; three deviations less pass
    share = (1 + least) / 2
    bits = math.floor(TOKENS * (share - 3 * math.sqrt(share * (1 - share) / TOKENS)))
    schema = f"a {kind}, b {kind}, path bigint"
    level, found = signed.select("id", "s1", "s2", F.explode("paths").alias("path")), None
    total = signed.count()
    for depth in range(1, max_depth + 1):
        most = max(bucket, total // HOT_CLASSES)
        hot = materialize(level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("path"), "hot")
        few = F.broadcast(hot)  # at most HOT_CLASSES for each run and node of a record
        met = level.join(few, "path", "left_anti").repartition("path").sortWithinPartitions("path")
        met = materialize(met.mapInPandas(lambda frames: _buckets(frames, bits, bucket), schema), "met")
        pairs = met.where("b IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        large = met.where("b IS NULL").select(F.col("a").alias("id"), "path").unionByName(level.join(few, "path").select("id", "path"))
        large = materialize(large, "large")
        if large.isEmpty():
            return found.distinct()
        if depth == max_depth:
            break

        def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                sig = [sampled_tokens(np.asarray(g)) for g in f["grams"]]
                sk = [sketch(x) for x in sig]
                yield pd.DataFrame({"id": f["id"], "sig": [x.tobytes() for x in sig], "s1": [x[0] for x in sk], "s2": [x[1] for x in sk]})

        def deeper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(len(f), TOKENS)
                old = f["path"].to_numpy().view(np.uint64)
                row, token = _children(old, least)
                yield pd.DataFrame({"id": f["id"].to_numpy()[row], "s1": f["s1"].to_numpy()[row], "s2": f["s2"].to_numpy()[row], "path": _step(old[row], token, sig[row, token]).view(np.int64)})

        ids = large.select("id").distinct()
        sigs = shingle_sets(only(texts, ids), n).mapInPandas(again, f"id {kind}, sig binary, s1 bigint, s2 bigint")
        level = materialize(large.join(sigs, "id").mapInPandas(deeper, f"id {kind}, s1 bigint, s2 bigint, path bigint").distinct(), "paths")
    sizes = large.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / (bucket // 2)).cast("int").alias("blocks"))
    both = large.join(signed.select("id", "s1", "s2"), "id").join(sizes, "path").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "id", "s1", "s2")
    last = both.repartition("path").sortWithinPartitions("path").mapInPandas(lambda frames: _buckets(frames, bits, 1 << 30), schema)
    return found.unionByName(last.select("a", "b")).distinct()


def near_duplicates(df: DataFrame, id_col: str, text, least: float = 0.8, n: int = 5, runs: int | None = None, bucket: int = BUCKET, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: id, rep, copies: each text with the representative of the texts that have the same set of
    n-word sequences. links: a, b, similarity: representatives, a < b, whose sets share at least `least` of their union.

    Every link returned is exact; each is found with a probability of TARGET_RECALL at least. Null texts and texts under n words
    take no part. Copies of one text are one representative, however many. Other columns of df aren't read. Texts are read three
    times at most instead of keeping their sets: for the paths, for buckets that are split again, and for pairs to be verified.
    """
    runs = runs or runs_for(least)
    path, token = _roots(runs, least)
    texts = texts_of(df, id_col, text)

    def sign(grams: np.ndarray) -> tuple:
        sig = sampled_tokens(grams)
        return (*sketch(sig), _step(path, token, sig[token]).view(np.int64))

    signed = materialize(set_names(texts, n, sign, "s1 bigint, s2 bigint, paths array<bigint>"), "signed")
    kinds = materialize(classes(signed), "classes")
    members = join_classes(signed.select("id", "h1", "h2"), kinds, ["h1", "h2"]).select("id", "rep", "copies")
    reps = materialize(signed.join(kinds.select("rep"), signed["id"] == F.col("rep"), "left_semi").select("id", "s1", "s2", "paths"), "reps")
    pairs = materialize(candidate_pairs(reps, texts, least, n, runs, bucket, max_depth), "pairs")
    return members, jaccard_at_least(pairs, texts, "a", "b", least, n)


def _resolutions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, root, "ga_resolutions_1946_2019").where("content IS NOT NULL")
    return near_duplicates(r, "ord", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("content")), least=0.6, n=3)


def _pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of rows ord_a < ord_b, copies with each other and with what their text is linked to."""
    members = materialize(members, "members")
    side = members.select(F.col("rep").alias("class"), F.col("id").alias("member"), F.col("copies").alias("n"))
    within = members.where("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    copies = expand(within, side.where("n > 1"), side.where("n > 1")).where("x < y")
    x = expand(links, side, side).unionByName(copies)  # classes are disjoint and a link comes once: no pair comes twice
    return x.select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of rows, as the problem fixes them; p4_members and p4_links hold the same in a size in proportion to the rows."""
    return _pairs(*_resolutions(spark, root))


def p4_members(spark: SparkSession, root: str) -> DataFrame:
    """Per resolution with content: the least ord of those of the same text, and how many these are."""
    return _resolutions(spark, root)[0].select(F.col("id").alias("ord"), F.col("rep").alias("rep_ord"), "copies")


def p4_links(spark: SparkSession, root: str) -> DataFrame:
    """Links between representatives."""
    return _resolutions(spark, root)[1].select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"), F.round("similarity", 6).alias("similarity"))


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    """Per resolution with content: its group (the least ord in it) and its number of links to other texts."""
    members, links = _resolutions(spark, root)
    links = materialize(links, "links")
    comps = connected_components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of = materialize(members.where("id = rep").join(comps, "rep", "left").join(degree, "rep", "left").select("rep", "component", "n_links", F.col("copies").alias("c")), "groups")
    out = join_classes(members, of, ["rep"], "c")
    return out.select(F.col("id").alias("ord"), F.coalesce("component", "rep").alias("group_ord"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_members": p4_members, "p4_links": p4_links, "p4_groups": p4_groups}


def shared_sql(text: str, where: str) -> str:
    """SQL of pairs ord_a < ord_b of resolutions that share at least 60 % of their three-word sequences, by counting all of them."""
    return f"""w AS (SELECT ord, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM ga_resolutions_1946_2019 WHERE {where}),
        g AS (SELECT DISTINCT ord, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
        n AS (SELECT ord, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.ord < b.ord GROUP BY 1, 2),
        near AS (SELECT ord_a, ord_b FROM c JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE k >= 0.6 * (x.n + y.n - k))"""


_NEAR = shared_sql("coalesce(title, '') || ' ' || content", "content IS NOT NULL")
_SETS = "s AS (SELECT ord, md5(string_agg(g, '|' ORDER BY g)) AS h FROM g GROUP BY 1), m AS (SELECT ord, min(ord) OVER (PARTITION BY h) AS rep_ord, count(*) OVER (PARTITION BY h) AS copies FROM s)"
_LINKS = "l AS (SELECT ord_a, ord_b, round(k / (x.n + y.n - k), 6) AS similarity FROM c JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE k >= 0.6 * (x.n + y.n - k) AND ord_a IN (SELECT rep_ord FROM m) AND ord_b IN (SELECT rep_ord FROM m))"
SQL: dict[str, str] = {
    "p4_found": f"WITH {_NEAR} SELECT ord_a, ord_b FROM near",
    "p4_members": f"WITH {_NEAR}, {_SETS} SELECT ord, rep_ord, copies FROM m",
    "p4_links": f"WITH {_NEAR}, {_SETS}, {_LINKS} SELECT ord_a, ord_b, similarity FROM l",
    "p4_groups": f"""WITH RECURSIVE {_NEAR}, {_SETS}, {_LINKS}, e AS (SELECT ord_a AS x, ord_b AS y FROM l UNION SELECT ord_b, ord_a FROM l),
        r AS (SELECT rep_ord AS x, rep_ord AS y FROM m UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), c2 AS (SELECT x, min(y) AS least FROM r GROUP BY 1), d AS (SELECT x, count(*) AS k FROM e GROUP BY 1)
        SELECT ord, c2.least AS group_ord, copies, coalesce(d.k, 0) AS n_links FROM m JOIN c2 ON c2.x = rep_ord LEFT JOIN d ON d.x = rep_ord""",
}
