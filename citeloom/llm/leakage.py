"""Problem 8: documents that contain passages of held-out items, found through one FM-index for each shard of the corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.fmindex import FIRST, OTHER, SEP, FMIndex
from citeloom.runtime import table

#: Scripts written without spaces, whose characters count as words.
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")
GRAM = 4  # words of a search phrase
SHARD_WORDS = 1_000_000  # words of one index; a longer document has an index of its own
ITEM_BLOCK = 5_000  # items searched in one pass over the corpus


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def needed(n: int, part: float, edits: int) -> tuple[int, int, int]:
    """Of an item of n words: words that a stretch has at least, words of a phrase, phrases that any such stretch shares."""
    least = max(1, math.ceil(part * n - 1e-9))
    q = min(GRAM, least)
    return least, q, max(1, min(m - q + 1 - (m // edits) * q for m in range(least, n + 1)))


def _distances(diff: np.ndarray, starts: int, take) -> None:
    """Edit distances of all stretches of an item that begin at one of its first `starts` words, against all endings in a text:
    diff[i, j] tells whether word i of the item differs from word j. take(i, rows) sees them after each word of the item."""
    n, m = diff.shape
    cols = np.arange(m + 1, dtype=np.int32)
    d = np.zeros((starts, m + 1), np.int32)
    new = np.empty_like(d)
    for i in range(n):
        live = min(i + 1, starts)
        old, x = d[:live], new[:live]
        np.add(old, 1, out=x)
        np.minimum(x[:, 1:], old[:, :-1] + diff[i], out=x[:, 1:])
        x -= cols  # insertions: the least up to each place
        np.minimum.accumulate(x, axis=1, out=x)
        np.add(x, cols, out=old)
        take(i, old)


def best_stretch(item: list, doc: list, least: int, edits: int) -> tuple[int, int] | None:
    """(begin, end) in doc of the longest stretch of `item` of at least `least` words that doc holds with at most one word in
    `edits` changed, missing or added; None if there is none. The edit distances of all beginnings are kept side by side."""
    n, m = len(item), len(doc)
    if not m or n < least:
        return None
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    diff = np.array([code[w] for w in item])[:, None] != np.array([code.get(w, -1) for w in doc])[None, :]
    if n <= m:  # the whole item unchanged
        whole = np.flatnonzero(~np.lib.stride_tricks.sliding_window_view(diff, n, axis=1)[np.arange(n), :, np.arange(n)].any(0))
        if len(whole):
            return int(whole[0]), int(whole[0]) + n
    best: list = []

    def longest(i: int, d: np.ndarray) -> None:
        lengths = i + 1 - np.arange(len(d))
        low = d.min(1)
        ok = np.flatnonzero((lengths >= least) & (low * edits <= lengths))
        if len(ok) and (not best or (lengths[ok[0]], -low[ok[0]]) > best[0][:2]):
            best[:] = [(int(lengths[ok[0]]), -int(low[ok[0]]), int(ok[0]), i, int(d[ok[0]].argmin()))]

    _distances(diff, n - least + 1, longest)
    if not best:
        return None
    _, _, first, last, end = best[0]
    # read backwards from its end, the stretch's beginning is where the same distance is met
    back: list = []
    _distances(diff[first : last + 1, :end][::-1, ::-1], 1, lambda i, d: back.append(int(d[0].argmin())) if i == last - first else None)
    return end - back[0], end


class Items:
    """The items of one block as phrases over a vocabulary of their own."""

    def __init__(self, rows: list[tuple[int, str]], part: float, edits: int) -> None:
        self.ids, self.part, self.edits = [], part, edits
        self.vocab: dict[str, int] = {}
        self.words, self.need = [], []
        by_len: dict[int, dict[tuple, list]] = {}
        for item_id, text in rows:
            w = words(text or "")
            if not w:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            sym = [self.vocab.setdefault(x, FIRST + len(self.vocab)) for x in w]
            self.words.append(w)
            least, q, share = needed(len(w), part, edits)
            self.need.append((least, q, share, len(w) // edits))
            for off in range(len(sym) - q + 1):
                by_len.setdefault(q, {}).setdefault(tuple(sym[off : off + q]), []).append((k, off))
        self.grams = []
        for grams in by_len.values():
            counts = np.array([len(v) for v in grams.values()])
            flat = np.array([x for v in grams.values() for x in v], np.int64)
            self.grams.append((np.array(list(grams), np.int64), np.append(0, np.cumsum(counts)), flat))

    def hits(self, sym: np.ndarray, place: np.ndarray, doc_of: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first and last word of the region) for pairs that share as many phrases, in a band, as a leak must."""
        index = FMIndex(sym, FIRST + len(self.vocab))
        docs, items, diags, offs = [], [], [], []
        for grams, begins, flat in self.grams:
            lo, hi = index.search(grams)
            count = hi - lo
            total = int(count.sum())
            if not total:
                continue
            gram = np.repeat(np.arange(len(grams)), count)
            rows = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + lo[gram]
            pos = index.locate(rows)
            uses = begins[gram + 1] - begins[gram]
            which = np.repeat(np.arange(total), uses)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(uses) - uses, uses) + begins[gram][which]
            k, off = flat[entry, 0], flat[entry, 1]
            docs.append(doc_of[pos[which]])
            items.append(k)
            offs.append(off)
            diags.append(place[pos[which]] - off)
        if not docs:
            return []
        docs, items, diags, offs = map(np.concatenate, (docs, items, diags, offs))
        need = np.array([x[2] for x in self.need])[items]
        band = np.array([x[3] for x in self.need])[items]
        span = np.int64(1) << 32
        pair = docs * len(self.ids) + items
        order = np.lexsort((diags, pair))
        pair, diags, need, band, docs, items = (x[order] for x in (pair, diags, need, band, docs, items))
        base = int(diags.min())
        group = np.cumsum(np.append(0, pair[1:] != pair[:-1]))
        key = group * span + (diags - base)
        reach = np.searchsorted(key, key + band, side="right")
        strong = np.flatnonzero(reach - np.arange(len(key)) >= need)
        out: dict[tuple[int, int], list[int]] = {}
        for i in strong:
            p = (int(docs[i]), int(items[i]))
            lo_, hi_ = int(diags[i]), int(diags[reach[i] - 1])
            if p in out:
                spans = out[p]
                if lo_ <= spans[-1][1] + 2 * int(band[i]) + 2:
                    spans[-1][1] = max(spans[-1][1], hi_)
                else:
                    spans.append([lo_, hi_])
            else:
                out[p] = [[lo_, hi_]]
        return [(d, k, a, b) for (d, k), spans in out.items() for a, b in spans]


def _search(frames: Iterator[pd.DataFrame], items: Items, shard_words: int) -> Iterator[pd.DataFrame]:
    get = items.vocab.get
    ids: list = []
    texts: list[str] = []
    parts: list[np.ndarray] = []
    lens: list[int] = []
    size = 0

    def flush() -> pd.DataFrame | None:
        nonlocal ids, texts, parts, lens, size
        if not size:
            ids, texts, parts, lens = [], [], [], []
            return None
        sym = np.concatenate(parts)
        place = np.concatenate([np.arange(x) for x in lens])
        doc_of = np.repeat(np.arange(len(lens)), lens)
        # a run of foreign words matches nothing: one stands for all, places keep the true distances
        keep = np.append(True, ~((sym[1:] == OTHER) & (sym[:-1] == OTHER)))
        out = []
        for d, k, lo, hi in items.hits(sym[keep].astype(np.int64), place[keep], doc_of[keep]):
            item, (least, _, _, band) = items.words[k], items.need[k]
            spans = [m.span() for m in WORD.finditer(texts[d].lower())]
            low = texts[d].lower()
            a, b = max(0, lo - band - 1), min(len(spans), hi + len(item) + band + 1)
            found = best_stretch(item, [low[x:y] for x, y in spans[a:b]], least, items.edits)
            if found and found[1] > found[0]:
                out.append((ids[d], items.ids[k], spans[a + found[0]][0], spans[a + found[1] - 1][1]))
        ids, texts, parts, lens, size = [], [], [], [], 0
        return pd.DataFrame(out, columns=["doc_id", "item_id", "begin_pos", "end_pos"])

    for f in frames:
        for doc_id, text in zip(f["doc_id"], f["text"]):
            w = [get(x, OTHER) for x in WORD.findall(text.lower())]
            w.append(SEP)
            ids.append(doc_id)
            texts.append(text)
            parts.append(np.array(w, np.int32))
            lens.append(len(w))
            size += len(w)
            if size >= shard_words:
                if (x := flush()) is not None:
                    yield x
    if (x := flush()) is not None:
        yield x


def find_leaks(docs: DataFrame, items: DataFrame, part: float = 0.6, edits: int = 8, shard_words: int = SHARD_WORDS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, begin_pos, end_pos): documents that hold one stretch of at least `part` of an item's words with at most
    one word in `edits` changed, missing or added, and where it stands in the text.

    docs: doc_id, text. items: item_id, text: the held-out query set. Both may have other columns, which aren't read.
    Every partition of docs is cut into shards of about `shard_words` words; each shard gets an FM-index, in which all phrases of
    four words of all items are searched backwards, located through sampled positions, and counted in bands: a stretch as above
    shares a least number of phrases with its item (q-gram lemma), so no true case is lost. What is left is aligned exactly.
    Nothing is shuffled. Items go to the tasks in blocks of `item_block`, one pass over docs each, so what is broadcast stays
    bounded however many items there are. Null or empty texts and items hold nothing. Repeated documents and items each count.
    An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ids = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ids}, item_id {item_type}, begin_pos bigint, end_pos bigint"
    texts = docs.where("text IS NOT NULL AND text != ''").select("doc_id", "text")
    out, block = None, []

    def searched(rows: list) -> DataFrame:
        known = spark.sparkContext.broadcast(Items(rows, part, edits))
        return texts.mapInPandas(lambda frames: _search(frames, known.value, shard_words), schema)

    for r in items.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == item_block:
            out, block = (searched(block) if out is None else out.unionByName(searched(block))), []
    if block:
        out = searched(block) if out is None else out.unionByName(searched(block))
    return spark.createDataFrame([], schema) if out is None else out


def removal_spans(leaks: DataFrame) -> DataFrame:
    """(doc_id, begin_pos, end_pos, n_items): overlapping leaks of a document merged. The rows of one document are its leaks only."""
    w = Window.partitionBy("doc_id").orderBy("begin_pos", "end_pos")
    before = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = leaks.withColumn("opens", F.coalesce((F.col("begin_pos") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(w))
    return marked.groupBy("doc_id", "run").agg(F.min("begin_pos").alias("begin_pos"), F.max("end_pos").alias("end_pos"), F.count_distinct("item_id").alias("n_items")).drop("run")


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, root: str) -> DataFrame:
    return removal_spans(_leaks(spark, root))


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Per item, also those that leak nowhere, the number of documents that hold it."""
    leaks = _leaks(spark, root).select("doc_id", "item_id").distinct().groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))
    return table(spark, root, "eval_items").select("item_id", "split").join(leaks, "item_id", "left").fillna(0, ["n_docs"])


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_items": p8_items}
SQL: dict[str, str] = {}
