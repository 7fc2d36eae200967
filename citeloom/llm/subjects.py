"""Problem 2: the subject areas of documents, from one-versus-rest linear classifiers of their paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.scan_repair import BREAKS, line_features, skeleton, weak_labels
from citeloom.llm.shingles import mix64
from citeloom.runtime import table

BITS = 16  # hashed features: 2 ** BITS
SAMPLE_ROWS = 2_500  # documents of the bounded sample that the classifiers are fitted on
LEAST_FEATURES = 4  # a paragraph of fewer words and pairs of words is a heading or a number and bears no subject
LEAST_THRESHOLD = 0.4  # procedural paragraphs, which stand with all areas, score an area's share of the documents; no area reaches this
SHARE = 0.25  # part of the subject-bearing paragraphs from which on a document is about an area
_WORD = re.compile(r"[^\W\d_][\w'’!†@|\-]*[\w†@!|]|[^\W\d_]", re.UNICODE)
_BREAK = re.compile(rf"[{BREAKS}]\s*$")
_BULLET = re.compile(r"^\W*(?:\d{1,3}|[a-z]|[ivxlc]{1,6})[.)]\s+", re.I)


_NOISE, _SIGN = re.compile(r"\W+"), re.compile(r"\w")


def _is(x: str, name: str) -> bool:
    """Whether a line says what the skeleton `name` stands for, punctuation and misread letters aside."""
    m = _SIGN.search(x)
    return m is not None and skeleton(m.group())[:1] == name[:1] and skeleton(_NOISE.sub(" ", x)).strip() == name


def paragraphs(content: str, title: str | None) -> list[str]:
    """The paragraphs of a text, wrapped lines joined, headers, page numbers and the title left out."""
    name = skeleton(re.sub(r"\W+", " ", title or "")).strip()
    lines = content.split("\n")
    if len(lines) > 1:
        lines = [x for x in lines if not name or not _is(x, name)]
        drop = weak_labels(lines, title, line_features(lines, title)) == 1
        lines = [x for x, d in zip(lines, drop) if not d]
    out: list[str] = []
    cur = last = ""
    for line in lines:
        s = line.strip()
        if not s:
            last = last if last and last[-1] not in ",;.:" else ""
            continue
        fresh = not cur or not last or line[:1].isspace() and last[-1] in ",;.:" or last[-1] in ",;.:" and (s[0].isupper() or _BULLET.match(s)) or (_BULLET.match(s) and last[-1] in ",;.:")
        if not fresh and line[:1].isspace() and s[0].isupper() and not _BREAK.search(last):
            fresh = len(last) < 50 or last[-1] in ",;.:"
        if fresh:
            if cur:
                out.append(cur)
            cur = s
        elif _BREAK.search(cur) and s[0].islower():
            cur = _BREAK.sub("", cur) + s
        else:
            cur += " " + s
        last = s
    if cur:
        out.append(cur)
    return [p for p in out if not _is(p, name)] if name else [p for p in out if _SIGN.search(p)]


def _stem(word: str) -> str:
    """Skeleton of a word without the ending of the plural."""
    w = word.lower()
    w = w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w
    k = skeleton(w)
    return k[:-1] if len(k) > 4 and k[-1] == "5" and k[-2] != "5" else k


_KNOWN: dict[str, tuple[int, bool]] = {}  # words seen by this process: hash of the stem, and whether it is long enough to count


def features(pars: list[str]) -> list[np.ndarray]:
    """Of each paragraph the hashes of words and pairs of words, in skeleton form, so that misread words count as what they were.
    Names and numbers are left out; words written with a capital inside the paragraph count as names. All are hashed in one go."""
    if len(_KNOWN) > 1_000_000:
        _KNOWN.clear()
    hashes, long_, size = [], [], []
    for par in pars:
        words = _WORD.findall(_BULLET.sub("", par))
        size.append(len(words))
        for k, w in enumerate(words):
            if k and w[:1].isupper():
                hashes.append(0)
                long_.append(False)
                continue
            if (got := _KNOWN.get(w)) is None:
                stem = _stem(w)
                got = _KNOWN[w] = (xxhash.xxh3_64_intdigest(stem) | 1 if stem else 0, len(stem) > 2)
            hashes.append(got[0])
            long_.append(got[1])
    h, owner, single = np.array(hashes, np.uint64), np.repeat(np.arange(len(pars)), size), np.array(long_, bool)
    both = (h[:-1] != 0) & (h[1:] != 0) & (owner[:-1] == owner[1:])
    with np.errstate(over="ignore"):
        value = mix64(np.concatenate([h[single], (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[both]])) & np.uint64((1 << BITS) - 1)
    key = np.sort((np.concatenate([owner[single], owner[:-1][both]]) << BITS) | value.astype(np.int64))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, len(pars)))) if pars else []


@dataclass
class Areas:
    """names, one weight column and one threshold for each area."""

    names: list[str]
    weight: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of each area for each row of features."""
        z = np.tile(self.bias, (len(rows), 1))
        full = [k for k, r in enumerate(rows) if len(r)]
        if full:
            flat = np.concatenate([rows[k] for k in full])
            size = np.array([len(rows[k]) for k in full])
            sums = np.add.reduceat(self.weight[flat], np.cumsum(size) - size, axis=0)
            z[full] += sums / np.sqrt(size)[:, None]
        return 1 / (1 + np.exp(-z))

    def areas(self, rows: list[np.ndarray]) -> np.ndarray:
        """Whether each row of features is about each area: every area that reaches its threshold, so a row may have several."""
        if not rows:
            return np.zeros((0, len(self.names)), bool)
        bears = np.array([len(r) >= LEAST_FEATURES for r in rows])
        return bears[:, None] & (self.scores(rows) >= self.threshold[None, :])


class Fitter:
    """One-versus-rest logistic regression on a bounded set of rows, each area's classifier fitted in a task of its own by
    full-batch gradient steps with per-feature rates (AdaGrad)."""

    def __init__(self, spark: SparkSession, rows: list[np.ndarray], names: list[str]) -> None:
        self.spark, self.names = spark, names
        self.keep = [k for k, r in enumerate(rows) if len(r)]
        rows = [rows[k] for k in self.keep]
        size = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        self.used, col = np.unique(flat, return_inverse=True)
        order = np.argsort(col, kind="stable")
        row_of = np.repeat(np.arange(len(rows)), size)
        begin, by_col = np.cumsum(size) - size, np.searchsorted(col[order], np.arange(len(self.used)))
        self.data = spark.sparkContext.broadcast((col.astype(np.int32), begin, (1 / np.sqrt(size)).astype(np.float32), row_of[order].astype(np.int32), by_col))

    def fit(self, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.7, ridge: float = 1e-4) -> Areas:
        labels = self.spark.sparkContext.broadcast((y[self.keep].astype(np.float32), weight[self.keep].astype(np.float32)))
        data, n_used = self.data, len(self.used)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            col, begin, scale, rows_by_col, col_begin = data.value
            ys, ws = labels.value
            share = ws / ws.sum()
            for f in frames:
                for c in f["id"]:
                    w, b = np.zeros(n_used, np.float32), np.float32(-2.0)
                    hw, hb = np.full(n_used, 1e-6, np.float32), np.float32(1e-6)
                    for _ in range(steps):
                        z = np.add.reduceat(w[col], begin) * scale + b
                        r = (1 / (1 + np.exp(-z)) - ys[:, c]) * share
                        g = np.add.reduceat((r * scale)[rows_by_col], col_begin) + ridge * w / len(begin)
                        hw += g * g
                        w -= rate * g / np.sqrt(hw)
                        gb = r.sum()
                        hb += gb * gb
                        b -= rate * gb / np.sqrt(hb)
                    yield pd.DataFrame({"area": [c], "w": [w.tobytes()], "b": [float(b)]})

        got = self.spark.range(0, len(self.names), 1, len(self.names)).mapInPandas(run, "area int, w binary, b double").collect()
        weight_, bias = np.zeros((1 << BITS, len(self.names)), np.float32), np.zeros(len(self.names), np.float32)
        for r in got:
            weight_[self.used, r["area"]], bias[r["area"]] = np.frombuffer(r["w"], np.float32), r["b"]
        return Areas(self.names, weight_, bias, np.full(len(self.names), 0.5, np.float32))


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s]


def calibrate(model: Areas, held: list[tuple[int, np.ndarray]], blank: list[np.ndarray], seed: int = 3) -> np.ndarray:
    """The threshold of each area with the best F1 over held-out passages: sentences of one area, each area's sentences put
    together with those of others, which have two areas, and paragraphs without an area."""
    rng = np.random.default_rng(seed)
    n = len(model.names)
    rows, truth = [r for _, r in held] + blank, np.zeros((len(held) + len(blank), n), bool)
    truth[np.arange(len(held)), [a for a, _ in held]] = True
    mixed = []
    for i, j in zip(rng.permutation(len(held)), rng.permutation(len(held))):
        if held[i][0] != held[j][0]:
            rows.append(np.union1d(held[i][1], held[j][1]))
            mixed.append((held[i][0], held[j][0]))
    t = np.zeros((len(mixed), n), bool)
    for k, (x, z) in enumerate(mixed):
        t[k, [x, z]] = True
    truth = np.concatenate([truth, t])
    p, out = model.scores(rows), np.full(n, 0.5, np.float32)
    for a in range(n):
        best = (-1.0, 0.5)
        for cut in np.arange(LEAST_THRESHOLD, 0.81, 0.05):
            hit = p[:, a] >= cut
            f1 = 2 * float((hit & truth[:, a]).sum()) / max(1.0, hit.sum() + truth[:, a].sum())
            if f1 > best[0] + 1e-9 or (f1 > best[0] - 1e-9 and abs(cut - 0.4) < abs(best[1] - 0.4)):
                best = (f1, float(cut))
        out[a] = best[1]
    return out


def fit_areas(spark: SparkSession, samples: list[tuple[str, str]], texts: list[tuple[np.ndarray, list[np.ndarray]]], rounds: int = 3) -> Areas:
    """The classifiers, from passages of known area and the features of a bounded sample of unlabelled (title, paragraphs).

    The passages hold part of each area's words only. So the classifiers label the paragraphs and section titles of the sample,
    weakly: a paragraph takes the area that its own words point to; one that they leave open takes, with less weight, the area of
    its section's title, or the main one of its document. Fitted again on these, the classifiers learn the words that keep such
    company; procedural phrases keep company with all areas and gain none. Every fourth passage is held out for the thresholds.
    """
    names = sorted({a for a, _ in samples})
    at = {a: k for k, a in enumerate(names)}
    said = [(i, at[a], s) for i, (a, t) in enumerate(samples) for s in _sentences(t)]
    known = [(i, a, r) for (i, a, _), r in zip(said, features([s for _, _, s in said]))]
    train = [k for k in known if k[0] % 4]
    held = [(a, r) for i, a, r in known if not i % 4 and len(r)]
    eye = np.eye(len(names), dtype=np.float32)
    base_rows = [r for _, _, r in train]
    base_y = eye[[a for _, a, _ in train]]
    model = Fitter(spark, base_rows, names).fit(base_y, np.ones(len(base_rows)))
    flat = [r for t, ps in texts for r in [t, *ps]]
    doc_of = np.array([d for d, (_, ps) in enumerate(texts) for _ in range(len(ps) + 1)])
    is_title = np.array([k == 0 for _, ps in texts for k in range(len(ps) + 1)])
    fitter = Fitter(spark, base_rows + flat, names) if flat else None
    blank: list[np.ndarray] = []
    for turn in range(rounds if flat else 0):
        p = model.scores(flat)
        order = np.sort(p, axis=1)
        top = p.argmax(1)
        sure = (order[:, -1] >= 0.5) & (order[:, -2] <= 0.3)
        main = np.full(len(texts), -1)
        votes = np.zeros((len(texts), len(names)))
        np.add.at(votes, (doc_of[sure], top[sure]), np.where(is_title[sure], 3.0, 1.0))
        main[votes.sum(1) > 0] = votes.argmax(1)[votes.sum(1) > 0]
        y, w = np.zeros((len(flat), len(names)), np.float32), np.full(len(flat), 0.15)
        y[sure] = eye[top[sure]]
        w[sure] = 1.0
        open_ = ~sure & (main[doc_of] >= 0) & ((order[:, -1] >= 0.08) if turn else True)
        y[open_] = eye[main[doc_of[open_]]]
        w[open_] = 0.3
        if turn == rounds - 1:  # at last, what no words point to has no area
            none = ~sure & (order[:, -1] < 0.2)
            y[none], w[none] = 0, 0.5
            blank = [flat[k] for k in np.flatnonzero(none)[: len(held)]]
        model = fitter.fit(np.concatenate([base_y, y]), np.concatenate([np.full(len(base_rows), 2.0), w]))
    if held:
        model.threshold = calibrate(model, held, blank)
    return model


def assign_areas(docs: DataFrame, samples: DataFrame, share: float = SHARE) -> DataFrame:
    """(ord, area, n_paragraphs, n_subject): areas that at least `share` of the subject-bearing paragraphs of content deal with. A
    paragraph deals with every area that reaches its threshold and bears a subject if there is one; paragraphs of fewer than
    LEAST_FEATURES words and pairs (headings, numbers) and words with a capital inside (names) tell no subject.

    docs: ord, title, content; samples: area, text, a bounded table of labelled passages. Extra columns aren't read. The
    classifiers are fitted, an area in a task, on SAMPLE_ROWS passages and documents at most, then applied to all paragraphs of all
    documents. Null and
    empty contents and texts without a subject-bearing paragraph have no row; equal documents have equal rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["ord"].dataType.simpleString()
    src = docs.where("ord IS NOT NULL AND content IS NOT NULL AND content != ''").select("ord", "title", "content")
    labelled = [(r[0], r[1]) for r in samples.where("area IS NOT NULL AND text IS NOT NULL").select("area", "text").orderBy(F.xxhash64("text"), "area", "text").limit(SAMPLE_ROWS).orderBy("area", "text").collect()]
    schema = f"ord {kind}, area string, n_paragraphs int, n_subject int"
    if not labelled:
        return spark.createDataFrame([], schema)

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [features([t or "", *paragraphs(c, t)]) for t, c in zip((t if isinstance(t, str) else None for t in f["title"]), f["content"])]
            yield pd.DataFrame({"title": [x[0] for x in got], "paragraphs": [x[1:] for x in got]})

    some = src.orderBy(F.xxhash64("ord")).limit(SAMPLE_ROWS).repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(seen, "title array<int>, paragraphs array<array<int>>").toPandas()
    own = [(np.asarray(t, np.int32), [np.asarray(p, np.int32) for p in ps]) for t, ps in zip(some["title"], some["paragraphs"])]
    model = spark.sparkContext.broadcast(fit_areas(spark, labelled, own))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for f in frames:
            out = []
            pars, owner = [], []
            for k, (t, c) in enumerate(zip(f["title"], f["content"])):
                ps = paragraphs(c, t if isinstance(t, str) else None)
                pars += ps
                owner += [k] * len(ps)
            got = m.areas(features(pars))
            counts, subject = np.zeros((len(f), len(m.names)), int), np.zeros(len(f), int)
            own = np.array(owner, int)
            np.add.at(counts, own, got.astype(int))
            np.add.at(subject, own, got.any(1).astype(int))
            for k, o in enumerate(f["ord"]):
                n = int(subject[k])
                out += [(o, m.names[a], int(counts[k, a]), n) for a in np.flatnonzero(counts[k]) if counts[k, a] >= share * n]
            yield pd.DataFrame(out, columns=["ord", "area", "n_paragraphs", "n_subject"])

    return src.mapInPandas(run, schema)


def _assigned(spark: SparkSession, root: str) -> DataFrame:
    return assign_areas(table(spark, root, "ga_resolutions_1946_2019"), table(spark, root, "subject_samples"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _assigned(spark, root).select("ord", "area")


def p2_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents and subject-bearing paragraphs of each area of subject_areas."""
    a = _assigned(spark, root).groupBy("area").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_paragraphs").alias("n_paragraphs"))
    return table(spark, root, "subject_areas").select("area").join(a, "area", "left").fillna(0, ["n_documents", "n_paragraphs"])


QUERIES = {"p2_found": p2_found, "p2_composition": p2_composition}
SQL: dict[str, str] = {}
