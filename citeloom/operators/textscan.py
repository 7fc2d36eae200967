"""Search of many titles in many texts, and citations that the edge table lacks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import SPACE, contains_regex
from citeloom.runtime import materialize


def _words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


NEEDLE_CHARS = 2_000_000  # characters of the needles that one automaton holds; so much is broadcast at most


def _automaton(rows: list) -> ahocorasick.Automaton:
    """One automaton of needles; a needle that several ids have gives them all."""
    by: dict[str, list] = {}
    for i, text in rows:
        by.setdefault(text, []).append(i)
    found = ahocorasick.Automaton()
    for text, ids in by.items():
        found.add_word(text, ids)
    found.make_automaton()
    return found


def _scan(t: DataFrame, rows: list, kind: str, keep: list[str]) -> DataFrame:
    """(__t, keep, __n) by one pass over the texts with one automaton of the needles `rows`, built once in each task."""
    spark = t.sparkSession
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema if f.name != "__x"] + [f"`__n` {kind}"])
    if not rows:
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast(rows)
    names = ["__t", *keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _automaton(known.value)
        for f in frames:
            at, ids = [], []
            for k, x in enumerate(f["__x"]):
                held = {i for _, found in find.iter(x) for i in found}
                at += [k] * len(held)
                ids += held
            out = f[names].iloc[at].reset_index(drop=True)
            out["__n"] = pd.Series(ids, dtype=object)
            yield out

    return t.select("__t", *keep, "__x").mapInPandas(run, schema)


def containment_join(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str, keep: list[str] | None = None, limit: int = NEEDLE_CHARS) -> DataFrame:
    """(text_id, needle_id): needles that occur in a text, ignoring case, the white space between words as written.

    The needles are measured first. Up to `limit` characters they are broadcast as one automaton (Aho and Corasick, 1975), which
    finds all of them in one pass over the texts: no text is shuffled, whatever a needle's length or a word's frequency. Beyond
    that, needles of three words or more are anchored: of its inner words, which a hit holds whole, the one found in the fewest
    texts is joined by equality with the texts' words, and what meets is verified, the texts being joined once. Those shorter have
    no inner word and take automata of at most `limit` characters, a pass each. Null and empty texts and needles hold nothing and
    are held nowhere. `keep`: columns of the texts to be carried along. Equal rows come out once.
    """
    keep = keep or []
    t = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text_id).alias("__t"), F.lower(F.col(text)).alias("__x"), *keep)
    n = needles.where(F.col(needle).isNotNull() & (F.col(needle) != "")).select(F.col(needle_id).alias("__n"), F.lower(F.col(needle)).alias("__y")).distinct()
    kind = n.schema["__n"].dataType.simpleString()
    names = [F.col("__t").alias(text_id), F.col("__n").alias(needle_id), *keep]
    n = materialize(n, "needles")
    size = n.agg(F.coalesce(F.sum(F.length("__y")), F.lit(0)).alias("c")).first()["c"]
    if size <= limit:
        return _scan(t, [tuple(r) for r in n.collect()], kind, keep).select(*names).distinct()
    words = _words(F.col("__y"))
    n = n.withColumn("__inner", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    anchored = n.where(F.size("__inner") > 0)
    # how many texts hold each inner word: counted for the words that needles have
    asked = anchored.select(F.explode("__inner").alias("__w")).distinct()
    held = materialize(t.select("__t", F.explode(F.array_distinct(_words(F.col("__x")))).alias("__w")).join(asked, "__w", "left_semi"), "words")
    df = held.groupBy("__w").agg(F.count(F.lit(1)).alias("__df"))
    choice = anchored.select("__n", "__y", F.explode("__inner").alias("__w")).join(df, "__w")
    choice = choice.groupBy("__n", "__y").agg(F.min_by("__w", F.struct("__df", "__w")).alias("__w"))
    out = held.join(choice, "__w").join(t, "__t").where(F.contains("__x", "__y")).select(*names)
    short = n.where(F.size("__inner") == 0).select("__n", "__y")
    blocks = -(-(short.agg(F.coalesce(F.sum(F.length("__y")), F.lit(0)).alias("c")).first()["c"]) // limit)
    for k in range(blocks):  # shares of about `limit` characters, by hash
        out = out.unionByName(_scan(t, [tuple(r) for r in short.where(F.pmod(F.xxhash64("__y"), F.lit(blocks)) == k).collect()], kind, keep).select(*names))
    return out.distinct()


@dataclass
class TitleSpec:
    """A document whose citations are looked for by title.

    res_id: its unlettered id. variants: titles of which any one counts. avoid: patterns of texts that don't count. match:
    'literal' or 'regex'. allow: the giving ids that were accepted, empty for all; deny: refused ones. also_cite: further
    unlettered ids that the same hits cite. accept: whether the hits become edges. expect_n: their number, checked if given.
    """

    res_id: str
    variants: list[str]
    avoid: list[str] = field(default_factory=list)
    match: str = "literal"
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    also_cite: list[str] = field(default_factory=list)
    accept: bool = True
    expect_n: int | None = None


def givers(edges: DataFrame) -> DataFrame:
    """(giving, text, day): the documents that cite anything, once each, with their text and first day. The text is kept as the
    least of a document's rows (they are copies), by partial aggregation."""
    return edges.where("res_id2_doc_giving_cite IS NOT NULL").groupBy(F.col("res_id2_doc_giving_cite").alias("giving")).agg(F.min("content_giv").alias("text"), F.min("day_giv").alias("day"))


def title_scan(documents: DataFrame, edges: DataFrame, titles: DataFrame) -> DataFrame:
    """(giving, res_id): documents that hold a title of res_id without citing it and are strictly later; one job for all titles.

    documents: giving, text, day. edges: giving, res_id, those that exist. titles: res_id, title, day; several rows of one res_id
    are variants. A document doesn't cite itself. A null text holds nothing, a null day on either side isn't later.
    """
    named = titles.withColumn("__k", F.xxhash64("res_id", "title"))
    hits = containment_join(documents, "giving", "text", named, "__k", "title", keep=["day"])
    ref = named.select("__k", "res_id", F.col("day").alias("ref_day")).distinct()
    later = hits.join(ref, "__k").where((F.col("day") > F.col("ref_day")) & (F.col("giving") != F.col("res_id")))
    known = edges.select(F.col("giving").alias("__g"), F.col("res_id").alias("__r")).distinct()
    return later.join(known, (F.col("giving") == F.col("__g")) & (F.col("res_id") == F.col("__r")), "left_anti").select("giving", "res_id").distinct()


def spec_scan(documents: DataFrame, edges: DataFrame, specs: list[TitleSpec], days: DataFrame, strict: bool = False) -> DataFrame:
    """(giving, res_id, hit_of): hits of hand-made specifications, which may hold patterns; one pass for all of them.

    days: res_id, day. Literal variants are tested as literals, others as patterns, all ignoring case; a null text is no hit, or
    an error if strict. hit_of is the specification's res_id, res_id what the new edge cites (it or also_cite).
    """
    spark = documents.sparkSession
    known = [s.res_id for s in specs]
    if len(known) != len(set(known)):
        raise ValueError("a res_id has two specifications")

    def one(s: TitleSpec) -> Column:
        text = F.col("text")
        hit = F.lit(False)
        for v in s.variants:
            hit = hit | (contains_regex(text, v, strict) if s.match == "regex" else F.coalesce(F.contains(F.lower(text), F.lit(v.lower())), F.lit(False)))
        for a in s.avoid:
            hit = hit & ~contains_regex(text, a)
        if s.allow:
            hit = hit & F.col("giving").isin(s.allow)
        if s.deny:
            hit = hit & ~F.col("giving").isin(s.deny)
        return F.when(hit, F.lit(s.res_id))

    hits = documents.select("giving", "day", F.explode(F.array_compact(F.array(*[one(s) for s in specs]))).alias("hit_of"))
    hits = hits.join(days.select(F.col("res_id").alias("hit_of"), F.col("day").alias("ref_day")), "hit_of").where((F.col("day") > F.col("ref_day")) & (F.col("giving") != F.col("hit_of")))
    e = edges.select(F.col("giving").alias("__g"), F.col("res_id").alias("__r")).distinct()
    hits = hits.join(e, (F.col("giving") == F.col("__g")) & (F.col("hit_of") == F.col("__r")), "left_anti").select("giving", "hit_of").distinct()
    targets = spark.createDataFrame([(s.res_id, t) for s in specs for t in [s.res_id, *s.also_cite]] or [("", "")], "hit_of string, res_id string")
    return hits.join(targets, "hit_of").select("giving", "res_id", "hit_of")


def accepted(hits: DataFrame, specs: list[TitleSpec]) -> DataFrame:
    """New edges (res_id2_doc_giving_cite, res_id2_unlet_recv) of the accepted specifications; counts are checked first."""
    counted = [s for s in specs if s.expect_n is not None]
    if counted:
        n = {r[0]: r[1] for r in hits.where(F.col("hit_of") == F.col("res_id")).where(F.col("hit_of").isin([s.res_id for s in counted])).groupBy("hit_of").count().collect()}
        for s in counted:
            if n.get(s.res_id, 0) != s.expect_n:
                raise AssertionError(f"{s.res_id}: {n.get(s.res_id, 0)} hits, expected {s.expect_n}")
    take = [s.res_id for s in specs if s.accept]
    return hits.where(F.col("hit_of").isin(take)).select(F.col("giving").alias("res_id2_doc_giving_cite"), F.col("res_id").alias("res_id2_unlet_recv")).distinct()


def wrong_title_audit(documents: DataFrame, citing: DataFrame, wrong: str, right: str) -> DataFrame:
    """Documents of `citing` (giving) whose text holds the wrong title and not the right one; null texts hold neither."""
    d = documents.join(citing.select("giving").distinct(), "giving", "left_semi")
    has = lambda t: F.coalesce(F.contains(F.lower("text"), F.lit(t.lower())), F.lit(False))
    return d.where(has(wrong) & ~has(right)).select("giving")
