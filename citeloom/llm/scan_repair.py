"""Problem 3: text from scanned pages: running headers, page numbers, words broken across lines, misread characters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.boosting import Boosted
from citeloom.runtime import materialize, table

#: What scanning takes for what, right -> misread.
CONFUSIONS = [("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("e", "c"), ("g", "q"), ("o", "0"), ("s", "5"), ("a", "@"), ("t", "†"), ("l", "1"), ("i", "1"), ("i", "!"), ("b", "6"), ("z", "2"), ("g", "9"), ("h", "b")]
INTRUDERS = "01569!@†2|¢$€£"
BREAKS = "\\-‐‑\xad¬"  # for character classes
SAMPLE_ROWS = 3_000  # rows of the bounded sample on which the line classifier is fitted
SAMPLE_WORDS = 4_000  # trusted types of the bounded sample on which the ranking of replacements is fitted
BAND = 8  # characters that two words may be out of step
JOINTS = 4_000  # joints of the bounded sample on which their classifier is fitted
RARE = 3  # types of so few uses are looked up however clean the rows they stand in
FREQUENT = 30  # uses in the sample from which a type that stands in unscanned rows too needs no look-up

_NUM = r"(?:[\dlOoIS|]{0,4}\d[\dlOoIS|]{0,4}|[ivxlc]{1,7}|[IVXLC]{1,7}|l{1,2}[0-9o]|lo)"
PAGE = re.compile(rf"^(?:[\-–—(\[]\s*)?(?:[Pp](?:age|agc|aqe)?\.?\s*)?{_NUM}(?:\s*/\s*{_NUM})?(?:\s*[\-–—)\]])?$")
#: Every confusable character in its most misread form, chains of confusions followed to their end.
_SKELETON = str.maketrans({"m": "rr1", "n": "r1", "u": "11", "d": "c1", "w": "vv", "h": "11", "e": "c", "g": "q", "9": "q", "o": "0", "s": "5", "a": "@", "t": "†", "l": "1", "i": "1", "!": "1", "|": "1"})


def skeleton(word: str) -> str:
    """The word with every confusable letter in its most misread form: a word and all its misreadings have one skeleton."""
    return word.lower().translate(_SKELETON)


def _heads() -> re.Pattern:
    """Shapes of running headers, read through skeleton() so that misread letters don't matter."""
    k = skeleton
    #: The wordings of running headers.
    shapes = [rf"(?:\d+\s+)?{k('assembly')} [—–\-] \S[^,;.]{{0,40}}?{k('session')}(?:\s+\d+)?$", rf"{k('official')} {k('records')},.{{0,60}}{k('supplement')}.{{0,20}}$",
              rf"{k('distr')}\.\s+{k('general')}\b", rf"{k('decisions')} {k('adopted')} {k('on')} {k('the')} {k('reports')} {k('of')} {k('the')} [^,;.]{{0,30}}$"]
    return re.compile("|".join(f"(?:{x})" for x in shapes))


_SK_HEADS = _heads()
_CODE = re.compile(r"^(?:\d{1,4} )?A/\w+/PV\.\w+(?: \d{1,4})?$|^A/\S+ E\S{4,8} [Pp]\S{2,3} \w+$")
#: Headings inside a text, which look like headers but are none.
_INNER = re.compile(r"^(?:ANNEX|PART|SECTION|CHAPTER|APPENDIX|TITLE|[A-Z]\.)(?:\s|$)")


_NUMBERS = re.compile(r"[\dl]{2,}|\d")


def _mask(s: str) -> str:
    """A line whose white space is single, numbers as one sign, read through skeleton()."""
    return skeleton(_NUMBERS.sub("#", s))


FEATURES = 21


def line_features(lines: list[str], title: str | None) -> np.ndarray:
    """Per line: its own shape, and its pairs with the lines before and after it (blank ones passed over)."""
    n = len(lines)
    x = np.zeros((n, FEATURES))
    s = [" ".join(y.split()) for y in lines]
    full = [k for k in range(n) if s[k]]
    page = [bool(PAGE.match(y)) and y != "" for y in s]
    number = [int(m.group()) if page[k] and (m := re.search(r"\d+", y)) else None for k, y in enumerate(s)]
    numbers = {v for v in number if v is not None}
    feed = [("\x0c" in y) for y in lines]
    t = skeleton(re.sub(r"\s+", " ", title or "").strip())
    tw = set(t.split())
    mask = {k: _mask(s[k]) for k in full}
    masks = Counter(mask.values())
    indents = Counter(len(lines[k]) - len(lines[k].lstrip()) for k in full)
    usual = {v for v, c in indents.items() if c >= max(2, 0.15 * len(full))}
    head = [False] * n
    for k in full:
        y = s[k]
        sk = skeleton(y)
        up = sum(map(str.isupper, y)) / max(1, sum(map(str.isalpha, y)))
        words = set(sk.split())
        like = len(words & tw) / max(1, len(words | tw)) if tw else 0.0
        shaped = bool(_SK_HEADS.match(sk))
        head[k] = shaped and y[-1] not in ",;" or bool(_CODE.match(y)) or (up > 0.8 and len(y) > 10 and len(words) > 2 and not _INNER.match(y))
        x[k, 0] = page[k]
        x[k, 1] = y[0] in "-–—([" and y[-1] in "-–—)]" and len(y) > 1
        x[k, 2] = number[k] is not None and (number[k] - 1 in numbers or number[k] + 1 in numbers)
        x[k, 3] = shaped
        x[k, 4] = bool(_CODE.match(y))
        x[k, 5] = up
        x[k, 6] = like
        x[k, 7] = like > 0.95 and (y.isupper() == (title or "").isupper())
        x[k, 8] = y[-1] in ",;.:"
        x[k, 9] = min(len(y), 120)
        x[k, 10] = len(words)
        x[k, 11] = (len(lines[k].replace("\x0c", "")) - len(lines[k].replace("\x0c", "").lstrip())) in usual
        x[k, 12] = y[:1].islower()
        x[k, 20] = bool(_INNER.match(y)) and not x[k, 3]
        x[k, 13] = masks[mask[k]]
    for i, k in enumerate(full):
        before, after = (full[i - 1] if i else None), (full[i + 1] if i + 1 < len(full) else None)
        x[k, 14] = before is not None and (page[before] or head[before])
        x[k, 15] = after is not None and (page[after] or head[after])
        x[k, 16] = before is None
        x[k, 17] = feed[k] or any(feed[(before or 0) : k]) or any(feed[k : (after if after is not None else n - 1) + 1])
        # do the neighbours read on over this line?
        x[k, 18] = before is not None and after is not None and s[before][-1] not in ",;.:" and s[after][:1].islower()
        x[k, 19] = before is not None and s[before][-1] not in ",;.:"
    return x


def weak_labels(lines: list[str], title: str | None, x: np.ndarray) -> np.ndarray:
    """1: surely a header or page number, 0: surely text, -1: unknown. A row without any line shaped like a page number or header
    is all text; in others strict shapes beside page breaks are furniture and lines of sentences are text."""
    y = np.full(len(lines), -1)
    full = x[:, 9] > 0
    strict = full & (((x[:, 0] > 0) & ((x[:, 1] > 0) | (x[:, 2] > 0) | (x[:, 14] > 0) | (x[:, 15] > 0) | (x[:, 17] > 0))) | ((x[:, 3] > 0) & (x[:, 8] == 0)) | (x[:, 4] > 0))
    strict &= x[:, 20] == 0
    shout = full & (x[:, 5] > 0.8) & (x[:, 20] == 0) & (x[:, 6] > 0.5) & (x[:, 7] == 0)
    strict |= shout & ((x[:, 14] > 0) | (x[:, 15] > 0) | (x[:, 17] > 0) | (x[:, 18] > 0))
    if not (strict.any() or (full & (x[:, 0] > 0)).any()):
        y[full] = 0
        return y
    y[strict] = 1
    y[full & ~strict & ((x[:, 8] > 0) | (x[:, 9] > 60)) & (x[:, 5] < 0.5) & (x[:, 0] == 0)] = 0
    y[full & ~strict & ((x[:, 7] > 0) | (x[:, 20] > 0))] = 0
    return y


def fit_lines(rows: list[tuple[str | None, str]]) -> Boosted:
    """The classifier of furniture, fitted on weak labels of a bounded sample of (title, content)."""
    xs, ys = [], []
    for title, content in rows:
        lines = content.split("\n")
        x = line_features(lines, title)
        y = weak_labels(lines, title, x)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    x = np.concatenate(xs) if xs else np.zeros((0, FEATURES))
    y = np.concatenate(ys) if ys else np.zeros(0)
    if len(np.unique(y)) < 2:
        x = np.concatenate([x, np.zeros((2, FEATURES)), np.eye(FEATURES)[:1]])
        y = np.append(y, [0, 0, 1])
    return Boosted(rounds=50, depth=4).fit(x, y)


def furniture(rows: list[tuple[str | None, list[str]]], model: Boosted) -> list[list[str | None]]:
    """'header', 'page_no' or None for each line of each row (title, lines); all lines are put to the model at once."""
    xs = [line_features(lines, title) for title, lines in rows]
    x = np.concatenate(xs) if xs else np.zeros((0, FEATURES))
    p = np.zeros(len(x))
    full = x[:, 9] > 0
    if full.any():
        p[full] = model.predict(x[full])
    out, at = [], 0
    for _, lines in rows:
        bad = set(np.flatnonzero(p[at : at + len(lines)] >= 0.5).tolist())
        out.append([("page_no" if PAGE.match(" ".join(line.split())) else "header") if k in bad else None for k, line in enumerate(lines)])
        at += len(lines)
    return out


_LETTERED = re.compile(r"^[A-Z]{1,3}\.\d")
_STRIP = ".,;:()“”\"'‘’[]?"
_ORDINAL = re.compile(r"^(?:\d+(?:st|nd|rd|th|d)?|[ivxlcdm]+|\d+[a-z]?|\d[\d.,/\-]*)$", re.I)


_READ: dict[str, str] = {}  # tokens seen by this process and the words that they are


def _word(token: str) -> str:
    """The word of a token, lower case, outer punctuation off; '' for codes, numbers and lettered numbers."""
    t = token.strip(_STRIP).replace("\xad", "")
    if t and "/" not in t and any(map(str.isalpha, t)) and not _ORDINAL.match(t) and not _LETTERED.match(t):
        return t.lower()
    return ""


def tokens(line: str) -> list[str]:
    """Words of a line, lower case, outer punctuation off; codes, numbers and lettered numbers left out."""
    if len(_READ) > 1_000_000:
        _READ.clear()
    out = []
    for t in line.split():
        if (w := _READ.get(t)) is None:
            w = _READ[t] = _word(t)
        if w:
            out.append(w)
    return out


@dataclass
class Parsed:
    """A row's lines: kind of furniture (or None), and the joints: (line, first part, mark, line of second part, second part)."""

    lines: list[str]
    kinds: list[str | None]
    joints: list[tuple[int, str, str, int, str]]


_BROKEN = re.compile(rf"([^\s{BREAKS}—]+(?:-[^\s{BREAKS}—]+)*)([{BREAKS}])$")
_MARKS = set("-‐‑\xad¬")


def parse(rows: list[tuple[str | None, str]], model: Boosted) -> list[Parsed]:
    """The rows (title, content) of a batch, parsed."""
    texts = [(title, content.split("\n")) for title, content in rows]
    out = []
    for (_, lines), kinds in zip(texts, furniture(texts, model)):
        text = [k for k in range(len(lines)) if kinds[k] is None and lines[k].strip()]
        joints = []
        for a, b in zip(text, text[1:]):
            end = lines[a].rstrip()
            if end[-1] not in _MARKS:
                continue
            m = _BROKEN.search(end.rsplit(None, 1)[-1])
            if m and m.group(1)[-1:].isalnum() | (m.group(1)[-1:] in INTRUDERS):
                second = lines[b].split()[0]
                joints.append((a, m.group(1).lstrip(_STRIP).lower(), m.group(2), b, second.rstrip(_STRIP).lower()))
        out.append(Parsed(lines, kinds, joints))
    return out


_SIGNS = re.compile(rf"\x0c|[\xad¬]\s*$|[^\W\d_][{re.escape(INTRUDERS)}]+[^\W\d_]", re.M)


def scanned(p: Parsed) -> bool:
    """Whether a row comes from a page: furniture, words broken at the ends of lines, form feeds, signs within words."""
    return any(p.kinds) or bool(p.joints) or any(_SIGNS.search(x) for x in p.lines)


def _frequent(rows: list[tuple[str | None, str]], model: Boosted, min_share: float) -> frozenset:
    """Types of the sample that are trusted whatever the other rows hold: at least FREQUENT uses, enough of them in unscanned rows."""
    n: Counter = Counter()
    clean: Counter = Counter()
    for p in parse(rows, model):
        ws = [w for k, line in zip(p.kinds, p.lines) if k is None for w in tokens(line)]
        n.update(ws)
        if not scanned(p):
            clean.update(ws)
    return frozenset(w for w, c in n.items() if c >= FREQUENT and clean[w] >= min_share * c and not any(ch in INTRUDERS for ch in w))


def _grams(w: str) -> set[str]:
    q = 2 if len(w) <= 7 else 3
    p = "^" + w + "$"
    return {p[i : i + q] for i in range(len(p) - q + 1)}


def distance(a: str, b: str) -> tuple[float, int]:
    """(cost, edits) of reading b as a, where a confusion costs 0.2 and any other changed character 1."""
    n, m = len(a), len(b)
    inf = 99.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(max(0, i - BAND), min(m, i + BAND) + 1):
            c = d[i][j]
            if c >= 4:
                continue
            if i < n and j < m and c + (a[i] != b[j]) < d[i + 1][j + 1]:
                d[i + 1][j + 1] = c + (a[i] != b[j])
            if i < n and c + 1 < d[i + 1][j]:
                d[i + 1][j] = c + 1
            if j < m and c + 1 < d[i][j + 1]:
                d[i][j + 1] = c + 1
            for right, wrong in CONFUSIONS:
                if b.startswith(right, j) and a.startswith(wrong, i) and c + 0.2 < d[i + len(wrong)][j + len(right)]:
                    d[i + len(wrong)][j + len(right)] = c + 0.2
    return d[n][m], abs(n - m)


def pair_features(word: str, n: int, other: str, m: int) -> list[float]:
    cost, _ = distance(word, other)
    a, b = _grams(word), _grams(other)
    return [cost, float(skeleton(word) == skeleton(other)), np.log1p(m), np.log1p(n), np.log((m + 1) / (n + 1)), len(word), len(a & b) / len(a | b), float(any(c in INTRUDERS for c in word)), float(word[:1] == other[:1]), abs(len(word) - len(other))]


def fit_ranking(trusted: list[tuple[str, int]], seed: int = 5) -> Boosted:
    """The ranking of replacements, fitted on trusted types of a bounded sample: some are misread on purpose and shall come
    back; others stand for unseen right words, whose neighbours shall be refused."""
    rng = np.random.default_rng(seed)
    words = [w for w, _ in trusted]
    count = dict(trusted)
    index: dict[str, list[str]] = {}
    for w in words:
        for g in _grams(w):
            index.setdefault(g, []).append(w)

    def near(w: str) -> list[str]:
        c: Counter = Counter()
        for g in _grams(w):
            for o in index.get(g, ()):
                if abs(len(o) - len(w)) <= 2 and o != w:
                    c[o] += 1
        return [o for o, _ in c.most_common(8)]

    x, y = [], []
    pick = [words[i] for i in rng.permutation(len(words))[:1500]]
    for k, w in enumerate(pick):
        if len(w) < 3:
            continue
        if k % 2:  # a right word that happens to be rare
            for o in near(w)[:4]:
                x.append(pair_features(w, int(rng.integers(1, 4)), o, count[o]))
                y.append(0)
            continue
        bad = w
        for _ in range(1 + (rng.random() < 0.15)):
            spots = [(i, r, m) for r, m in CONFUSIONS[:15] for i in range(len(bad)) if bad.startswith(r, i)]
            if spots:
                i, r, m = spots[rng.integers(len(spots))]
                bad = bad[:i] + m + bad[i + len(r) :]
        if bad == w or bad in count:
            continue
        for o in {w, *near(bad)[:5]}:
            x.append(pair_features(bad, int(rng.integers(1, 4)), o, count[o]))
            y.append(int(o == w))
    if len(set(y)) < 2:
        x += [[0.2, 1, 5, 1, 3, 6, 0.6, 1, 1, 0], [3, 0, 1, 1, 0, 6, 0.2, 0, 0, 2]]
        y += [1, 0]
    return Boosted(rounds=50, depth=3).fit(np.array(x, float), np.array(y, float))


def fit_joints(known: list[tuple[list[float], bool]]) -> Boosted:
    """The classifier of line pairs that break a word: whether the mark vanishes. Fitted on a bounded sample of joints of which one
    form, joined or hyphenated, is known and used more; every other one is shown once more without its forms' counts, so that the
    parts, their lengths and the mark decide where no form is known. A soft mark always vanishes."""
    x, y = [[0, 0, 5, 5, 0, 6, 4, 1, 0], [0, 0, 0, 0, 0, 4, 4, 1, 0], [0, 0, 0, 0, 1, 4, 4, 1, 0]], [0, 1, 1]
    for k, (f, joined) in enumerate(known):
        x.append(f)
        y.append(int(joined or f[4] > 0))
        if k % 2:
            x.append([0.0, 0.0, *f[2:7], 1.0, f[8]])
            y.append(y[-1])
    return Boosted(rounds=40, depth=4).fit(np.array(x, float), np.array(y, float))


@dataclass
class Scan:
    """Results over a table: parts, rows of (ord, line_no, kind); fixes, replacement of each misread type, broken words' included;
    joins, the words broken across lines (ord, line_no, to, a, b, vanish, form): both parts, lines from the first to the second,
    whether the break mark vanishes, and the right form where a part is misread; edits, all that texts() applies."""

    parts: DataFrame
    fixes: DataFrame
    joins: DataFrame
    edits: DataFrame
    lines: Boosted


def repair(rows: DataFrame, min_share: float = 0.3) -> Scan:
    """Lines to repair in rows (ord, title, content); extra columns aren't read. Null and empty contents have none.

    1. Lines: a boosted classifier over pairs of neighbouring lines, fitted on weak labels of SAMPLE_ROWS rows, tells headers and
       page numbers from text.
    2. Words: all rows' types are counted, in rows with signs of a scanned page and without. A type that stands in the others too
       (at least `min_share` of its uses) is trusted. For the rest, and for types of RARE uses at most, trusted types sharing a quarter
       of their character q-grams (found through the rarest of them) or their skeleton are retrieved by inverted joins; a boosted
       ranking, fitted on words misread on purpose, chooses the replacement or none.
    3. Joints: whether a word broken across lines, page furniture between them passed over, is one word or keeps its hyphen is
       decided by a boosted classifier of the pair of lines: uses of the joined and of the hyphenated form and of the parts over all
       rows, looked up by skeleton so that misread parts count, the mark, and the parts' lengths.
    Counts cover all rows; look-ups are joins, broadcast by Spark only below its size threshold.
    """
    spark = rows.sparkSession
    kind = rows.schema["ord"].dataType.simpleString()
    src = rows.where("ord IS NOT NULL AND content IS NOT NULL AND content != ''").select("ord", "title", "content")
    sample = src.orderBy(F.xxhash64("ord")).limit(SAMPLE_ROWS).select("title", "content").collect()
    lines_model = fit_lines([(r[0], r[1]) for r in sample])
    known = spark.sparkContext.broadcast((lines_model, _frequent([(r[0], r[1]) for r in sample], lines_model, min_share)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each type of a batch (scanned or not), each furniture line and each joint."""
        model, common = known.value
        for f in frames:
            out = []
            types: Counter = Counter()
            rows = [(t if isinstance(t, str) else None, c) for t, c in zip(f["title"], f["content"])]
            for o, p in zip(f["ord"], parse(rows, model)):
                of_page = scanned(p)
                out += [(o, k, x, None, None, None, 0, of_page) for k, x in enumerate(p.kinds) if x]
                cut = {(a, "end") for a, *_ in p.joints} | {(b, "start") for *_, b, _ in p.joints}
                for k, line in enumerate(p.lines):
                    if p.kinds[k] is None and line.strip():
                        ws = line.split()
                        if (k, "start") in cut:
                            ws = ws[1:]
                        if (k, "end") in cut:
                            ws = ws[:-1]
                        for w in tokens(" ".join(ws)):
                            types[w, of_page] += 1
                            if w not in common:
                                out.append((o, k, "word", w, None, None, 0, of_page))
                out += [(o, a, "joint", first, second, mark + str(b - a), 0, of_page) for a, first, mark, b, second in p.joints]
            out += [(None, None, "type", w, None, None, n, s) for (w, s), n in types.items()]
            yield pd.DataFrame(out, columns=["ord", "line_no", "kind", "a", "b", "c", "n", "scanned"]).astype({"ord": "Int64", "line_no": "Int64"})

    read_ = materialize(src.mapInPandas(read, f"ord {kind}, line_no bigint, kind string, a string, b string, c string, n bigint, scanned boolean"), "lines")
    types = read_.where("kind = 'type'").groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("scanned"), F.col("n")).otherwise(0)).alias("clean"))
    sk = F.pandas_udf(lambda s: s.map(skeleton), "string")
    intruder = F.col("w").rlike("[" + re.escape(INTRUDERS).replace("|", "\\|") + "]")
    types = materialize(types.withColumn("trusted", (F.col("clean") >= F.greatest(F.lit(1), min_share * F.col("n"))) & ~intruder), "types")
    trusted = types.where("trusted").select("w", "n")
    sample_words = [(r[0], r[1]) for r in trusted.where("n >= 5").orderBy(F.desc("n"), "w").limit(SAMPLE_WORDS).collect()]
    ranking = spark.sparkContext.broadcast(fit_ranking(sample_words))

    # joints: forms joined and hyphenated, looked up by skeleton over trusted types
    forms = trusted.withColumn("k", sk("w")).groupBy("k").agg(F.sum("n").alias("uses"), F.max_by("w", "n").alias("form"))
    joint = read_.where("kind = 'joint'").select("ord", "line_no", "a", "b", "c").withColumn("kj", sk(F.concat("a", "b"))).withColumn("kh", sk(F.concat("a", F.lit("-"), "b"))).withColumn("ka", sk("a")).withColumn("kb", sk("b"))
    for c in ("kj", "kh", "ka", "kb"):
        joint = joint.join(forms.select(F.col("k").alias(c), F.col("uses").alias(c + "_n"), F.col("form").alias(c + "_form")), c, "left").fillna(0, [c + "_n"])
    soft = F.substring("c", 1, 1).isin("¬", "\xad")
    facts = F.array(*[c.cast("double") for c in (F.log1p("kj_n"), F.log1p("kh_n"), F.log1p("ka_n"), F.log1p("kb_n"), soft, F.length("a"), F.length("b"), F.col("kj_n") >= F.col("kh_n"), F.contains("a", F.lit("-")))])
    joint = joint.withColumn("facts", facts)
    some = joint.where("kj_n + kh_n > 0").orderBy(F.xxhash64("ord", "line_no")).limit(JOINTS).select("facts", "kj_n", "kh_n").collect()
    joints_model = spark.sparkContext.broadcast(fit_joints([(r[0], r[1] >= r[2]) for r in some]))
    vanish = F.pandas_udf(lambda x: pd.Series(joints_model.value.predict(np.array(x.tolist(), float).reshape(-1, 9)) >= 0.5, x.index), "boolean")("facts")
    joint = joint.withColumn("vanish", vanish).withColumn("w", F.concat("a", F.when(F.col("vanish"), "").otherwise("-"), "b")).withColumn("to", F.expr("CAST(substring(c, 2) AS bigint)"))
    joint = joint.withColumn("form", F.when(F.col("kj_n") >= F.col("kh_n"), F.col("kj_form")).otherwise(F.col("kh_form")))
    joint = materialize(joint.select("ord", "line_no", "a", "b", "w", "to", "vanish", "form"), "joints")

    # retrieval of candidates: rare q-grams first would do, but types are few next to texts, so all q-grams are joined and counted
    gram = F.pandas_udf(lambda s: s.map(lambda w: sorted(_grams(w))), "array<string>")
    doubtful = types.where((~F.col("trusted") | (F.col("n") <= RARE)) & (F.length("w") >= 2)).select("w", "n")
    # broken words of no known form are looked up like any other type
    unknown = joint.where("form IS NULL AND length(w) >= 2").groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(types.select("w"), "w", "left_anti")
    doubtful = materialize(doubtful.unionByName(unknown), "doubtful")
    right = trusted.where("n >= 2").withColumn("gs", gram("w")).select(F.col("w").alias("o"), F.col("n").alias("m"), F.explode("gs").alias("g"))
    # a candidate shares a quarter of the word's q-grams, so it shares one of the rarest three quarters and one
    left = doubtful.withColumn("gs", gram("w")).select("w", "n", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    left = left.join(right.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g")
    least = F.greatest(F.lit(1), F.floor(F.col("size") * 0.25))
    rank_ = F.row_number().over(Window.partitionBy("w").orderBy("df", "g"))  # the q-grams of one word
    known_grams = F.count(F.lit(1)).over(Window.partitionBy("w"))
    left = left.withColumns({"r": rank_, "k": known_grams}).where(F.col("r") <= F.col("k") - least + 1)
    met = left.join(right, "g").where(F.abs(F.length("w") - F.length("o")) <= 3).where("w != o").select("w", "n", "o", "m")
    # the skeleton finds what a short word's few q-grams can't
    own = doubtful.withColumn("k", sk("w")).join(trusted.where("n >= 2").withColumn("k", sk("w")).select("k", F.col("w").alias("o"), F.col("n").alias("m")), "k")
    met = met.unionByName(own.where((F.col("m") > F.col("n")) & (F.col("w") != F.col("o"))).select("w", "n", "o", "m")).distinct()

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            grams = {w: _grams(w) for w in {*f["w"], *f["o"]}}
            same = np.array([skeleton(w) == skeleton(o) for w, o in zip(f["w"], f["o"])], bool)
            near = np.array([len(grams[w] & grams[o]) >= max(1, int(0.25 * len(grams[w]))) for w, o in zip(f["w"], f["o"])], bool)
            f, same = f[near | same], same[near | same]
            if len(f):
                x = np.array([pair_features(*r) for r in zip(f["w"], f["n"], f["o"], f["m"])], float)
                yield f[["w", "o", "m"]].assign(score=ranking.value.predict(x) * ((x[:, 0] <= 0.65) | same))

    scored = met.mapInPandas(rank, "w string, o string, m bigint, score double").where("score >= 0.5")
    fixes = scored.groupBy("w").agg(F.max_by("o", F.struct("score", "m", "o")).alias("fix"))
    fixes = materialize(fixes, "fixes")
    again = fixes.select(F.col("w").alias("fix"), F.col("fix").alias("further"))  # a rare replacement may be misread itself
    fixes = materialize(fixes.join(again, "fix", "left").select("w", F.coalesce("further", "fix").alias("fix")).where("w != fix"), "fixes")

    words = read_.where("kind = 'word'").select("ord", "line_no", F.col("a").alias("w"))
    # types that are frequent and trusted in the sample but not over all rows: where they stand is read again
    astray = spark.createDataFrame([(w,) for w in sorted(known.value[1])] or [("",)], "w string").join(fixes, "w", "left_semi")
    if late := {r[0] for r in astray.collect()}:  # some of the sample's types

        def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(t if isinstance(t, str) else None, c) for t, c in zip(f["title"], f["content"])]
                out = [(o, k, w) for o, p in zip(f["ord"], parse(rows, known.value[0])) for k, line in enumerate(p.lines) if p.kinds[k] is None for w in tokens(line) if w in late]
                yield pd.DataFrame(out, columns=["ord", "line_no", "w"])

        words = words.unionByName(src.mapInPandas(again, f"ord {kind}, line_no bigint, w string"))
    words = words.join(fixes, "w")
    wrong = words.select("ord", "line_no").distinct().withColumn("kind", F.lit("misread"))
    # a broken word is misread where its part differs from the part of the best known form
    marks = "[" + re.escape(INTRUDERS).replace("|", "\\|") + "]"
    whole = joint.join(fixes, "w", "left").withColumn("form", F.coalesce("form", "fix")).drop("fix")
    whole = whole.withColumn("bad_a", F.coalesce(~F.startswith("form", F.col("a")), F.col("a").rlike(marks))).withColumn("bad_b", F.coalesce(~F.endswith("form", F.col("b")), F.col("b").rlike(marks)))
    joins = materialize(whole.withColumn("form", F.when(F.col("bad_a") | F.col("bad_b"), F.col("form"))), "joins")
    broken = joins.where("bad_a").select("ord", "line_no").unionByName(joins.where("bad_b").select("ord", (F.col("line_no") + F.col("to")).alias("line_no"))).withColumn("kind", F.lit("misread"))
    furniture_ = read_.where("kind IN ('header', 'page_no')").select("ord", "line_no", "kind")
    parts = furniture_.unionByName(joins.where("vanish").select("ord", "line_no", F.lit("hyphen").alias("kind"))).unionByName(wrong).unionByName(broken).distinct()
    none, far = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    edits = furniture_.select("ord", "line_no", F.lit("drop").alias("op"), none.alias("a"), none.alias("b"), far.alias("to"))
    edits = edits.unionByName(words.select("ord", "line_no", F.lit("word").alias("op"), F.col("w").alias("a"), F.col("fix").alias("b"), far.alias("to")).distinct())
    edits = edits.unionByName(joins.select("ord", "line_no", F.when(F.col("vanish"), "join").otherwise("hyphen").alias("op"), F.col("a"), F.col("form").alias("b"), "to"))
    of_broken = joins.where("form IS NOT NULL").groupBy("w").agg(F.min("form").alias("fix")).join(fixes, "w", "left_anti")
    return Scan(parts, fixes.unionByName(of_broken), joins.select("ord", "line_no", "to", "a", "b", "vanish", "form"), edits, lines_model)


def recase(word: str, fix: str) -> str:
    """fix in the upper and lower case of the misread word."""
    low = word.lower()
    if len(low) != len(word):
        return fix
    if sum(c.isalpha() for c in word) > 1 and word.upper() == word:
        return fix.upper()
    out = []
    for op, i, j, k, m in SequenceMatcher(None, low, fix, autojunk=False).get_opcodes():
        out.append(word[i:j] if op == "equal" else fix[k:m].capitalize() if word[i:j][:1].isupper() else fix[k:m])
    return "".join(out)


#: A hyphen before these words is a suspended one ("two- and three-day").
_SUSPENDED = {"and", "or", "nor", "to"}
_ITEM = re.compile(r"^(?:\(?(?:\d{1,3}|[a-z]|[ivxl]{1,6})[.)]|[-–—•*])\s")


def repaired(title: str | None, content: str, edits: list) -> str:
    """The text of a row as paragraphs, one blank line between two: furniture dropped, joints and fixes applied.

    edits: (line_no, op, a, b, to) of Scan.edits. Lines are joined over page furniture and within what the row's layout shows as a
    paragraph: blank lines where it has them, else deeper first lines, else lines that end before the next word was due. White
    space within a paragraph becomes one space, soft hyphens go.
    """
    lines = content.split("\n")
    drop = {e[0] for e in edits if e[1] == "drop"}
    fix: dict[int, dict[str, str]] = {}
    for k, op, a, b, _ in edits:
        if op == "word":
            fix.setdefault(k, {})[a] = b
    joint = {e[0]: e for e in edits if e[1] in ("join", "hyphen")}
    seconds = {k + e[4] for k, e in joint.items()}
    text = [k for k in range(len(lines)) if k not in drop and lines[k].strip()]
    bare = {k: re.sub(r"[\x0c\s]+", " ", lines[k]).strip() for k in text}
    raw = {k: lines[k].replace("\x0c", "").rstrip() for k in text}
    indent = {k: len(raw[k]) - len(raw[k].lstrip()) for k in text}
    width = max(map(len, raw.values()), default=0)
    plain = [(a, b) for a, b in zip(text, text[1:]) if not any(k in drop for k in range(a, b))]
    blank = sum(b > a + 1 for a, b in plain) >= max(1, 0.1 * len(text))
    flush = min(indent.values(), default=0)
    wraps = any(bare[k][:1].islower() for k in text[1:])
    indented = not blank and wraps and any(indent[k] > flush for k in text) and any(indent[b] == flush for _, b in plain)
    known = skeleton(re.sub(r"\s+", " ", title or "").strip())

    def heading(k: int) -> bool:
        return skeleton(bare[k]) == known or bool(_INNER.match(bare[k])) and len(bare[k]) < 40 and bare[k][-1] not in ",;.:"

    def goes_on(a: int, b: int) -> bool:
        if a in joint:
            return True
        if heading(a) or heading(b):
            return False
        furnished = any(k in drop for k in range(a, b))
        ended, low = bare[a][-1] in ",;.:!?", bare[b][:1].islower()
        if low and not _ITEM.match(bare[b]):
            return b == a + 1 or furnished or not ended
        if furnished:
            return not ended
        if b > a + 1:
            return False
        if _ITEM.match(bare[b]) and ended:
            return False
        if blank:
            return True
        if indented:
            return indent[b] <= flush
        if len(raw[a]) + 1 + len(bare[b].split()[0]) + 2 <= width:
            return False
        return wraps and not ended

    out: list[list[str]] = []
    held: str | None = None  # first part of a word whose second part comes next
    for i, k in enumerate(text):
        words = lines[k].replace("\xad", "").split() if k not in joint else lines[k].split()
        first, last = (0 if k not in seconds else 1), (len(words) - 1 if k in joint else len(words))
        for j in range(first, last):
            core = words[j].strip(_STRIP).replace("\xad", "")
            if (f := fix.get(k, {}).get(core.lower())) is not None:
                lead = len(words[j]) - len(words[j].lstrip(_STRIP))
                words[j] = words[j][:lead] + recase(core, f) + words[j][len(words[j].rstrip(_STRIP)) :]
        if i == 0 or not goes_on(text[i - 1], k):
            out.append([])
        if held is not None and words:
            before = joint[text[i - 1]]
            mark, head, tail = held[-1], held[:-1], words[0]
            a = head[len(head) - len(before[2]) :]
            b = tail.rstrip(_STRIP)
            if k in joint and len(words) == 1:
                b = tail[:-1]  # broken again
            sep = "" if before[1] == "join" else "-" if mark in "¬\xad" else mark
            if before[1] == "hyphen" and before[3] is None and b.lower() in _SUSPENDED:
                out[-1].append(head + sep)
            else:
                whole = a + sep + b
                words[0] = head[: len(head) - len(a)] + (recase(whole, before[3]) if before[3] is not None else whole) + tail[len(b) :]
        held = words.pop() if k in joint and words else None
        out[-1] += words
    if held is not None:
        out[-1].append(held)
    return "\n\n".join(" ".join(w.replace("\xad", "") for w in p) for p in out if p)


def texts(rows: DataFrame, scan: Scan | None = None) -> DataFrame:
    """(ord, text): every row's content repaired. Null contents stay null and empty ones empty; rows of null ord have no marks and
    are left out, as in repair(). ord names a row; copies of a row come out as often as they stand in rows."""
    scan = scan or repair(rows)
    kind = rows.schema["ord"].dataType.simpleString()
    own = scan.edits.groupBy("ord").agg(F.collect_set(F.struct("line_no", "op", "a", "b", "to")).alias("edits"))
    src = rows.where("ord IS NOT NULL").select("ord", "title", "content").join(own, "ord", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for t, c, es in zip(f["title"], f["content"], f["edits"]):
                es = [] if es is None else [(e["line_no"], e["op"], e["a"], e["b"], e["to"]) for e in es]
                got.append(repaired(t if isinstance(t, str) else None, c, es) if isinstance(c, str) else None)
            yield pd.DataFrame({"ord": f["ord"], "text": pd.Series(got, f.index, object)})

    return src.mapInPandas(run, f"ord {kind}, text string")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ga_resolutions_1946_2019").select("ord", "title", "content")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return repair(_rows(spark, root)).parts.select("ord", "line_no", "kind")


def p3_fixes(spark: SparkSession, root: str) -> DataFrame:
    """The misread types and what replaces them."""
    return repair(_rows(spark, root)).fixes


def p3_text(spark: SparkSession, root: str) -> DataFrame:
    """Every row's content as continuous paragraphs."""
    return texts(_rows(spark, root))


QUERIES = {"p3_found": p3_found, "p3_fixes": p3_fixes, "p3_text": p3_text}
SQL: dict[str, str] = {}
