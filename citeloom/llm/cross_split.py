"""Problem 5: records of evaluation splits that also stand in the training split, by an exact prefix-filter join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import plain_identifier, strip
from citeloom.llm.near_duplicates import shared_sql
from citeloom.llm.shingles import WordHashes, expand, gram_hashes, jaccard_at_least, join_classes
from citeloom.runtime import materialize, table

LEAST_BITS, MOST_BITS = 16, 22  # counters of the rarity table: 16 for each text, between these powers of two (256 kB to 16 MB)
WORDS = 8  # 64-bit words of a set's bitmap
FILTER_BITS = 21  # hash classes of evaluation prefixes by which training sequences are left out: 2 million numbers at most


_MAP = [f"m{k}" for k in range(WORDS)]


def bitmap(grams: np.ndarray) -> list[int]:
    """A bit for each of the sequences' hash classes. Where bitmaps of two sets differ in h bits, the sets differ in h members at
    least, so they share (|a| + |b| - h) / 2 at most: an exact bound."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(grams & np.uint64(64 * WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _named(frames: Iterator[pd.DataFrame], n: int, bits: int) -> Iterator[pd.DataFrame]:
    """(id, class, size, bitmap) of each text with sequences, class a hash of its set; at the end (null, counter, count, null ...)
    of this task."""
    known = WordHashes()
    acc = np.zeros(1 << bits, np.int64)
    for f in frames:
        if len(known) > 1_000_000:
            known.clear()
        rows, all_ = [], []
        for i, g in zip(f["id"], gram_hashes(f["text"], n, known)):
            if len(g):
                rows.append((i, xxhash.xxh3_64_intdigest(g.tobytes()) - 2**63, len(g), *bitmap(g)))
                all_.append(g)
        if all_:
            acc += np.bincount((np.concatenate(all_) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield pd.DataFrame(rows, columns=["id", "class", "size", *_MAP]).astype({"id": object})
    at = np.flatnonzero(acc)
    none = pd.Series([None] * len(at), dtype=object)
    yield pd.DataFrame({"id": none, "class": at, "size": acc[at]} | {m: none for m in _MAP})


def prefixes(texts: DataFrame, counts, least: float, n: int) -> DataFrame:
    """(class, gram, pos, size): of each set the rarest sequences, so many that two sets sharing `least` of their union share one.
    Copies are one class and give their sequences once in each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare_of, bits = counts.value
        known = WordHashes()
        seen: set[int] = set()
        for f in frames:
            if len(known) > 1_000_000:
                known.clear()
            names, grams, sizes = [], [], []
            for g in gram_hashes(f["text"], n, known):
                if not len(g) or (c := xxhash.xxh3_64_intdigest(g.tobytes()) - 2**63) in seen:
                    continue
                seen.add(c)
                rare = rare_of[(g >> np.uint64(64 - bits)).astype(np.int64)]
                keep = len(g) - int(np.ceil(least * len(g) - 1e-9)) + 1
                names.append(c)
                sizes.append(len(g))
                grams.append(g[np.lexsort((g, rare))][:keep].view(np.int64))
            if names:
                many = [len(x) for x in grams]
                yield pd.DataFrame({"class": np.repeat(names, many), "gram": np.concatenate(grams), "pos": np.concatenate([np.arange(k) for k in many]), "size": np.repeat(sizes, many)})

    return texts.select("text").mapInPandas(run, "class bigint, gram bigint, pos int, size int")


def bipartite_links(left: DataFrame, right: DataFrame, counts, least: float, n: int) -> DataFrame:
    """(a, b): classes of left (id, text) and right whose sets may share `least` of their union, a different from b; of those that
    do none is missing.

    Sequences are put in one order for both sides, the rarest first (counts), so two sets that share enough share a sequence of
    their prefixes; pairs that meet there must fit in length and in what can still follow the meeting place. The prefixes of the
    left side, the evaluation's, are the index: sequences of the right side travel only if their hash class is among the index's
    (FILTER_BITS, a checked bound; nearly all pass where the index is far larger than that).
    """
    index = materialize(prefixes(left, counts, least, n), "index")
    bucket = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    asked = F.broadcast(index.select(bucket.alias("__k")).distinct())
    probe = prefixes(right, counts, least, n).withColumn("__k", bucket).join(asked, "__k", "left_semi")
    one = index.select(F.col("class").alias("a"), "gram", F.col("pos").alias("pa"), F.col("size").alias("sa"))
    two = probe.select(F.col("class").alias("b"), "gram", F.col("pos").alias("pb"), F.col("size").alias("sb"))
    met = one.join(two, "gram").where(
        (F.col("a") != F.col("b")) & (F.col("sa") >= least * F.col("sb") - 1e-9) & (F.col("sb") >= least * F.col("sa") - 1e-9)
        & (1 + F.least(F.col("sa") - F.col("pa") - 1, F.col("sb") - F.col("pb") - 1) >= least / (1 + least) * (F.col("sa") + F.col("sb")) - 1e-6))
    return met.select("a", "b").distinct()


def same_key(classes: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """(a, b): classes of eval and of train that have one key, of classes (key, class, side). Keys of more than `cell` pairs are
    salted: their eval classes are dealt out to tasks and their train classes go to each of these."""
    classes = materialize(classes, "keyed")
    sizes = classes.groupBy("key").agg(F.count_if(F.col("side") == "eval").alias("e"), F.count_if(F.col("side") == "train").alias("t")).where("e > 0 AND t > 0")
    sizes = sizes.select("key", F.least(F.ceil(F.col("e") * F.col("t") / cell), F.lit(512)).cast("int").alias("salts"))
    dealt = classes.join(sizes, "key")
    left = dealt.where("side = 'eval'").select("key", F.col("class").alias("a"), F.expr("CAST(pmod(class, salts) AS int)").alias("salt"))
    right = dealt.where("side = 'train'").select("key", F.col("class").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["key", "salt"]).select("a", "b")


def _side(df: DataFrame, which: str) -> DataFrame:
    """(class, member, n) of one side of (id, class, side), n the class's size there."""
    own = df.where(F.col("side") == which).select("class", F.col("id").alias("member"))
    return materialize(join_classes(own, own.groupBy("class").agg(F.count(F.lit(1)).alias("n")), ["class"], "n"), "side")


@dataclass
class Found:
    """What stands on both sides: members, (how, side, class, member, n); links, (how, a, b), of classes of eval and of train."""

    members: DataFrame
    links: DataFrame
    sides: dict


def linked(rows: DataFrame, least: float = 0.6, n: int = 3) -> Found:
    """Classes of rows of val or test that stand in train too, and their links; see overlaps()."""
    spark = rows.sparkSession
    rows = materialize(rows.where("id IS NOT NULL AND split IN ('train', 'val', 'test')").select("id", "key", "text", F.when(F.col("split") == "train", "train").otherwise("eval").alias("side")), "rows")
    kind = rows.schema["id"].dataType.simpleString()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * rows.count()).bit_length()))
    texts = rows.where("text IS NOT NULL").select("id", "text", "side")
    named = materialize(texts.select("id", "text").mapInPandas(lambda frames: _named(frames, n, bits), f"id {kind}, class bigint, size bigint, " + ", ".join(f"{m} bigint" for m in _MAP)), "named")
    got = named.where("id IS NULL").groupBy("class").agg(F.sum("size").alias("n"))
    got = got.select(F.col("class").cast("int").alias("k"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()  # at most 2 ** bits numbers
    rare = np.zeros(1 << bits, np.int32)
    rare[got["k"].to_numpy()] = got["n"].to_numpy()
    del got
    counts = spark.sparkContext.broadcast((rare, bits))
    sides = {}

    keyed = rows.where("key IS NOT NULL AND key != ''").select("id", F.xxhash64("key", "text").alias("class"), "key", "side")
    sides["key"] = _side(keyed, "eval"), _side(keyed, "train")
    links = same_key(keyed.select("key", "class", "side").distinct()).withColumn("how", F.lit("key"))

    sets = named.where("id IS NOT NULL").select("id", "class").join(rows.select("id", "side"), "id")
    sides["text"] = te, tt = _side(sets, "eval"), _side(sets, "train")
    reps = [x.groupBy("class").agg(F.min("member").alias("id")) for x in (te, tt)]
    pairs = materialize(bipartite_links(texts.where("side = 'eval'"), texts.where("side = 'train'"), counts, least, n), "pairs")
    # a class is verified by its least member, if the bitmaps leave it open
    at = pairs
    for k, (c, o) in enumerate((("a", "x"), ("b", "y"))):
        own = named.where("id IS NOT NULL").join(reps[k], ["id", "class"]).select(F.col("class").alias(c), F.col("id").alias(f"__{o}"), F.col("size").alias(f"s{o}"), *[F.col(m).alias(f"{o}{m}") for m in _MAP])
        at = at.join(own, c)
    differ = sum((F.bit_count(F.col(f"x{m}").bitwiseXOR(F.col(f"y{m}"))) for m in _MAP), F.lit(0))
    both = F.col("sx") + F.col("sy")
    at = materialize(at.where((both - differ) / 2 >= least / (1 + least) * both - 1e-6).select("a", "b", "__x", "__y"), "open")
    near = jaccard_at_least(at, texts.select("id", "text"), "__x", "__y", least, n).select("a", "b")
    equal = reps[0].select(F.col("class").alias("a")).join(reps[1].select(F.col("class").alias("a")), "a").select("a", F.col("a").alias("b"))
    links = materialize(links.unionByName(near.unionByName(equal).withColumn("how", F.lit("text"))), "links")
    members = [x.select(F.lit(how).alias("how"), F.lit(side).alias("side"), "class", "member", "n") for how, pair in sides.items() for side, x in zip(("eval", "train"), pair)]
    return Found(members[0].unionByName(members[1]).unionByName(members[2]).unionByName(members[3]), links, sides)


def overlaps(rows: DataFrame, least: float = 0.6, n: int = 3) -> DataFrame:
    """(eval_id, train_id, how): rows of val or test that stand in train too. how: key, text.

    rows: id, key, text, split (train, val, test; anything else and null take no part, nor do null ids). Extra columns aren't
    read. Rows agree by key if their keys are equal and not null or empty, by text if the sets of n-word sequences share at least
    `least` of their union; texts under n words have none. Rows of one text (by key: of one key and text) are a class and compared
    once; every pair of their members comes out, dealt out to cells of bounded size. linked() has the same as classes and links,
    in a size in proportion to the rows.
    """
    found = linked(rows, least, n)
    out = [expand(found.links.where(F.col("how") == how), *found.sides[how]).withColumn("how", F.lit(how)) for how in ("key", "text")]
    return out[0].unionByName(out[1]).select(F.col("x").alias("eval_id"), F.col("y").alias("train_id"), "how")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "ga_resolutions_1946_2019").select("ord", plain_identifier("res_id2").alias("key"), F.col("content").alias("text"))
    s = table(spark, root, "resolution_splits").select("ord", F.lower(strip("split")).alias("split"))
    return r.join(s, "ord").select(F.col("ord").alias("id"), "key", "text", "split")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    o = overlaps(_rows(spark, root))
    return o.select(F.least("eval_id", "train_id").alias("ord_a"), F.greatest("eval_id", "train_id").alias("ord_b")).distinct()


def p5_members(spark: SparkSession, root: str) -> DataFrame:
    """The rows of p5_links' classes: how they agree (key or text), their side, their class as its least row there, its size."""
    found = linked(_rows(spark, root))
    m = found.members
    both = found.links.select("how", F.lit("eval").alias("side"), F.col("a").alias("class")).unionByName(found.links.select("how", F.lit("train").alias("side"), F.col("b").alias("class"))).distinct()
    kept = m.join(both, ["how", "side", "class"], "left_semi")
    least = kept.groupBy("how", "side", "class").agg(F.min("member").alias("rep_ord"), F.count(F.lit(1)).alias("c"))
    return join_classes(kept, least, ["how", "side", "class"], "c").select("how", "side", F.col("member").alias("ord"), "rep_ord", F.col("n").alias("copies"))


def p5_links(spark: SparkSession, root: str) -> DataFrame:
    """Links between classes of the evaluation and of train, each named by its least row on its side."""
    found = linked(_rows(spark, root))
    least = materialize(found.members.groupBy("how", "side", "class").agg(F.min("member").alias("rep")), "reps")
    name = lambda side, c, out: least.where(F.col("side") == side).select("how", F.col("class").alias(c), F.col("rep").alias(out))
    return found.links.join(name("eval", "a", "eval_ord"), ["how", "a"]).join(name("train", "b", "train_ord"), ["how", "b"]).select("how", "eval_ord", "train_ord")


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Per split and source of the evaluation row: its rows that stand in train, by key and by text. From classes and links."""
    found = linked(_rows(spark, root))
    has = found.links.select("how", F.col("a").alias("class")).distinct()
    o = found.members.where("side = 'eval'").join(has, ["how", "class"], "left_semi").groupBy(F.col("member").alias("ord")).agg(F.max(F.col("how") == "key").alias("k"), F.max(F.col("how") == "text").alias("t"))
    s = table(spark, root, "resolution_splits").select("ord", F.lower(strip("split")).alias("split"), "source")
    j = s.join(o, "ord")
    return j.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("k").alias("by_key"), F.count_if("t").alias("by_text"))


QUERIES = {"p5_found": p5_found, "p5_members": p5_members, "p5_links": p5_links, "p5_report": p5_report}
_PLAIN = r"regexp_replace(regexp_replace(lower({c}), '[\s\p{{Z}}\x0B\x{{85}}\x1C-\x1F]+', '', 'g'), '^a/res/', '')"
_CROSS = """((a.split = 'train' AND b.split IN ('val', 'test')) OR (b.split = 'train' AND a.split IN ('val', 'test')))"""
_BASE = f"""{shared_sql("content", "content IS NOT NULL")}, r AS (SELECT r.ord, {_PLAIN.format(c="r.res_id2")} AS k, r.content AS txt, lower(trim(s.split)) AS split, s.source FROM ga_resolutions_1946_2019 r JOIN resolution_splits s ON s.ord = r.ord WHERE s.split IS NOT NULL),
        p AS (SELECT 'text' AS how, ord_a, ord_b FROM near UNION SELECT 'key', a.ord, b.ord FROM r a JOIN r b ON a.k = b.k AND a.k <> '' AND a.ord < b.ord),
        f AS (SELECT p.how, CASE WHEN a.split = 'train' THEN b.ord ELSE a.ord END AS e, CASE WHEN a.split = 'train' THEN a.ord ELSE b.ord END AS t FROM p JOIN r a ON a.ord = ord_a JOIN r b ON b.ord = ord_b WHERE {_CROSS})"""
_NAMES = """h AS (SELECT ord, md5(string_agg(g, '|' ORDER BY g)) AS h FROM g GROUP BY 1), side AS (SELECT *, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side FROM r WHERE split IN ('train', 'val', 'test')),
        m AS (SELECT 'text' AS how, side, side.ord, min(side.ord) OVER w AS rep_ord, count(*) OVER w AS copies FROM side JOIN h ON h.ord = side.ord WINDOW w AS (PARTITION BY h, side)
              UNION ALL SELECT 'key', side, ord, min(ord) OVER w, count(*) OVER w FROM side WHERE k <> '' WINDOW w AS (PARTITION BY k, txt, side))"""
SQL: dict[str, str] = {
    "p5_found": f"WITH {_BASE} SELECT DISTINCT least(e, t) AS ord_a, greatest(e, t) AS ord_b FROM f",
    "p5_members": f"WITH {_BASE}, {_NAMES} SELECT how, side, ord, rep_ord, copies FROM m WHERE (side = 'eval' AND EXISTS (SELECT 1 FROM f WHERE f.how = m.how AND f.e = m.ord)) OR (side = 'train' AND EXISTS (SELECT 1 FROM f WHERE f.how = m.how AND f.t = m.ord))",
    "p5_links": f"WITH {_BASE}, {_NAMES} SELECT DISTINCT f.how, x.rep_ord AS eval_ord, y.rep_ord AS train_ord FROM f JOIN m x ON x.how = f.how AND x.side = 'eval' AND x.ord = f.e JOIN m y ON y.how = f.how AND y.side = 'train' AND y.ord = f.t",
    "p5_report": f"WITH {_BASE}, o AS (SELECT e, bool_or(how = 'key') AS ok, bool_or(how = 'text') AS ot FROM f GROUP BY 1) SELECT split, source, count(*) AS n_rows, count(*) FILTER (ok) AS by_key, count(*) FILTER (ot) AS by_text FROM o JOIN r ON r.ord = o.e GROUP BY 1, 2",
}
