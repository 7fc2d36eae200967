"""Problem 10: sentences of texts in any language, with abbreviations, collocations and sentence starters learnt unsupervised.

One pass over the corpus counts, per language, word types with and without a period and the pairs around sentence-final marks;
log-likelihood ratios over these counts give the model; a second pass classifies every mark with it. The language of a paragraph
is taken from its own script and function words, as declared languages are wrong too often and texts mix languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.runtime import materialize, table

CLOSERS = "\"'”’»›)]}」』）】〉》〗〕］｝"
OPENERS = "\"'“‘„«‹([{「『（【〈《〖〔［｛¿¡"
#: A mark of a script with spaces counts before white space or the end only, the others everywhere.
SPACED = ".!?…؟۔"
DENSE = "。！？．।॥｡"
_CL, _OP = re.escape(CLOSERS), re.escape(OPENERS)
MARK = re.compile(f"[{SPACED}]+[{_CL}]*(?:[   ]»)?[{_CL}]*(?=\\s|$|[{_OP}])|[{DENSE}]+[{_CL}]*")
AFTER = re.compile(f"[{SPACED}][{_CL}]*(?:[   ]»)?(\\s+)")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
#: Frequent function words, by which languages of one script are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with by on not from at which be as it are were has had",
    "fr": "le la les des du et un une dans pour que qui par sur au aux est avec son pas ce ne",
    "es": "el los las del y un una en para que por con se su al es lo como más no",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "pt": "o os as do da dos das e um uma em para que por com não se ao na no",
    "it": "il lo gli i di e un una in per che con non si del della dei nel al è",
}
_LANGS = list(FUNCTION_WORDS)
_VOTES: dict[str, list[int]] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_k)
_KEYS = frozenset(_VOTES)
_SCRIPT = re.compile("([A-Za-zÀ-ɏ])|([Ѐ-ӿ])|([؀-ۿ])|([ऀ-ॿ])|([぀-ヿ])|([㐀-鿿])|([^\\W\\d_])")
_SCRIPTS = ["latin", "ru", "ar", "hi", "ja", "zh"]
_TRIM = re.compile(f"^[{_OP}\\-—–]+|[{_CL},;:]+$")
_NUMBER = re.compile(r"^[+\-]?\d[\d.,:/\-]*$")
_ENUM = re.compile(r"\W*(?:[^\W\d_]+\s+)?(?:[IVXLCDM]+|[ivxlcdm]+|\d+|[^\W\d_])[.)]$")
_ZH_SPEECH = re.compile("[^。！？，；：“”]*?(?:问道|说道|答道|喊道|问|说|喊)[。！？，]")
_CASED = ("latin", "ru", "greek", "armenian", *FUNCTION_WORDS)  # all other scripts have one case only
_GAP, _TOKEN = re.compile(r"\s"), re.compile(r"\S+")
_JA_ON = "とっがをはにのもでへや、"


def language(par: str) -> str:
    """Language code of a paragraph: by the script of its first letter, for Latin letters by function words ('latin' if none is
    found); scripts without a code of their own have their Unicode name."""
    m = _SCRIPT.search(par)
    if not m:
        return "none"
    if m.lastindex > len(_SCRIPTS):
        return unicodedata.name(m.group(), "none").split()[0].lower()
    s = _SCRIPTS[m.lastindex - 1]
    if s == "latin":
        found = [w for w in par.lower().split() if w in _KEYS]
        if found:
            votes = [0] * len(FUNCTION_WORDS)
            for w in found:
                for k in _VOTES[w]:
                    votes[k] += 1
            return _LANGS[votes.index(max(votes))]
    elif s == "zh":
        return "ja" if re.search("[぀-ヿ]", par) else "zh"
    return s


def word_type(token: str) -> str:
    """Lower case, without brackets and quotation marks around it; numbers become one type."""
    t = _TRIM.sub("", token)
    bare = t[:-1] if t.endswith(".") else t
    return "##number##" if _NUMBER.match(bare) else bare.lower()


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the pieces between blank lines, white space off both ends."""
    at = 0
    for m in [*BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        if body := piece.strip():
            lead = len(piece) - len(piece.lstrip())
            yield at + lead, at + lead + len(body)
        at = m.end() if m else end


def _last_gap(par: str, begin: int, end: int, known: int) -> int:
    """Place of the last white space before `end`, `known` being that before `begin`."""
    for k in range(end - 1, begin - 1, -1):
        if par[k].isspace():
            return k
    return known


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of one partition: (lang, kind, a, b, n). kind: t token, p first of a paragraph, s pair around a mark."""
    for f in frames:
        raw: dict[str, Counter] = {}
        first: dict[str, Counter] = {}
        pairs: dict[str, Counter] = {}
        for text in f["text"]:
            for a, b in paragraphs(text):
                par = text[a:b]
                lang = language(par)
                # where words aren't parted by spaces, only the words of other scripts among them are tokens
                tokens = [x for x in par.split() if x.isascii()] if lang in ("zh", "ja") else par.split()
                if lang not in raw:
                    raw[lang], first[lang], pairs[lang] = Counter(), Counter(), Counter()
                raw[lang].update(tokens)
                if tokens:
                    first[lang][tokens[0]] += 1
                seen, gap, at = pairs[lang], -1, 0
                for m in AFTER.finditer(par):
                    gap, at = _last_gap(par, at, m.start(), gap), m.start()
                    if nxt := _TOKEN.match(par, m.end()):
                        seen[par[gap + 1 : m.start(1)], nxt.group()] += 1
        rows: Counter = Counter()
        for lang in raw:
            for tok, n in raw[lang].items():
                t = _TRIM.sub("", tok)
                ends = t.endswith(".") and len(t) > 1 and not t.endswith("..")
                rows[lang, "t", word_type(tok), f"{'.' if ends else ''}{'U' if t[:1].isupper() else 'l'}"] += n
            for tok, n in first[lang].items():
                rows[lang, "p", word_type(tok), ""] += n
            for (x, y), n in pairs[lang].items():
                t = _TRIM.sub("", x)
                a = word_type(x) if t.endswith(".") and len(t) > 1 and not t.endswith("..") else "##end##"
                rows[lang, "s", a, ("U" if _TRIM.sub("", y)[:1].isupper() else "l") + word_type(y)] += n
        if rows:
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["lang", "kind", "a", "b", "n"])


def _xlogy(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    return k * np.log(np.clip(p, 1e-12, 1.0))


def llr(both: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio (times 2) that b goes with a, of counts: both together, a, b, all."""
    p, p1, p2 = b / n, both / a, (b - both) / np.maximum(n - a, 1)
    same = _xlogy(both, p) + _xlogy(a - both, 1 - p) + _xlogy(b - both, p) + _xlogy(n - a - b + both, 1 - p)
    apart = _xlogy(both, p1) + _xlogy(a - both, 1 - p1) + _xlogy(b - both, p2) + _xlogy(n - a - b + both, 1 - p2)
    return 2 * (apart - same)


@dataclass
class Model:
    """abbrev: (lang, type); starters: (lang, type); bound: (lang, type, next type), pairs that hold together over a period."""

    abbrev: set = field(default_factory=set)
    starters: set = field(default_factory=set)
    bound: set = field(default_factory=set)


ABBREV_SCORE, STARTER_LLR, COLLOCATION_LLR, END_SHARE, LONG_ABBREV, NUMBER_SHARE = 0.3, 30.0, 7.88, 0.6, 3, 0.6
LEAST_SHARE = 1e-7  # part of a language's periods, openings or pairs that a type must have to be learnt: of each, at most 1e7 are


def learn(docs: DataFrame) -> Model:
    """The model of docs (column text), from counts over all of its texts; null and empty texts count nothing.

    Counts are added up in each task and then per type, so a frequent word costs one row per task. To the driver come only the
    types that pass a test: an abbreviation of k letters scores LLR * exp(-k) >= 0.3, so it needs a count of about exp(k) / 20;
    starters and collocations need an LLR of 30 or 7.88. All need LEAST_SHARE of their language's counts besides, which bounds
    their number whatever the corpus: what is rarer than that can't be told from chance by a share of a language's sentences.
    """
    counts = docs.where("text IS NOT NULL").select("text").mapInPandas(_count, "lang string, kind string, a string, b string, n bigint")
    counts = counts.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "marks")
    t = F.col("kind") == "t"
    dotted = F.col("b").startswith(".")
    types = counts.where(t).groupBy("lang", F.col("a").alias("w")).agg(
        F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("with_dot"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("b").endswith("l"), F.col("n")).otherwise(0)).alias("lower"))
    totals = {r["lang"]: (r["n"], r["with_dot"]) for r in types.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("with_dot").alias("with_dot")).collect()}
    model = Model()

    def abbreviations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["w"].str.contains(r"[^\W\d_]", regex=True)]
            if not len(f):
                continue
            size = np.array([totals[x][0] for x in f["lang"]], float)
            dots = np.array([totals[x][1] for x in f["lang"]], float)
            n, k = f["n"].to_numpy(float), f["with_dot"].to_numpy(float)
            p1, p2 = dots / size, 0.99
            score = 2 * (_xlogy(k, np.full_like(k, p2)) + _xlogy(n - k, np.full_like(k, 1 - p2)) - _xlogy(k, p1) - _xlogy(n - k, 1 - p1))
            inner = f["w"].str.count(r"\.").to_numpy()
            letters = f["w"].str.len().to_numpy() - inner
            score = score * np.exp(-letters.astype(float)) * (inner + 1) * np.power(np.maximum(letters, 1).astype(float), -(n - k))
            yield f.loc[(score >= ABBREV_SCORE) & (k >= LEAST_SHARE * dots), ["lang", "w"]]

    model.abbrev = {(r[0], r[1]) for r in types.where("with_dot > 0").mapInPandas(abbreviations, "lang string, w string").collect()}

    # sentence starters: types after a mark that ends a sentence for sure (no abbreviation before it), against their use at large
    s = counts.where("kind = 's'").select("lang", "a", F.substring("b", 1, 1).alias("case"), F.expr("substring(b, 2)").alias("w"), "n")
    abbrev = docs.sparkSession.createDataFrame([*model.abbrev] or [("", "")], "lang string, a string")
    # long words among the candidates mostly just stand at ends of sentences: they are judged below, by what follows them
    brief = abbrev.where(F.length("a") <= LONG_ABBREV)
    sure = s.join(F.broadcast(brief), ["lang", "a"], "left_anti").where("a != '##number##'")
    opening = sure.unionByName(counts.where("kind = 'p'").select("lang", "a", F.lit("U").alias("case"), F.col("a").alias("w"), "n"))
    opening = opening.groupBy("lang", "w").agg(F.sum("n").alias("opens"))
    breaks = {r[0]: r[1] for r in opening.groupBy("lang").agg(F.sum("opens")).collect()}

    def starters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            b = np.array([breaks[x] for x in f["lang"]], float)
            size = np.array([totals[x][0] for x in f["lang"]], float)
            k, n = f["opens"].to_numpy(float), np.maximum(f["n"].to_numpy(float), f["opens"].to_numpy(float))
            more = k / b > (n - k) / np.maximum(size - b, 1)
            upper, lower = n - f["lower"].to_numpy(float), f["lower"].to_numpy(float)
            # a word that is written small inside sentences and large after marks alone opens sentences however rare it is
            small = (lower >= 2) & (k >= 0.8 * upper) & f["lang"].isin(_CASED).to_numpy()
            yield f.loc[(k >= LEAST_SHARE * b) & (small | more & (llr(k, n, b, np.maximum(size, b)) >= STARTER_LLR)), ["lang", "w"]]

    joined = opening.where("opens >= 3").join(types.select("lang", "w", "n", "lower"), ["lang", "w"])
    model.starters = {(r[0], r[1]) for r in joined.mapInPandas(starters, "lang string, w string").collect()}

    # a type whose period is nearly always followed by an opener stands at ends of sentences; it needs no treatment of its own
    start = docs.sparkSession.createDataFrame([*model.starters] or [("", "")], "lang string, w string")
    opener = F.col("starts") & ((F.col("case") == "U") | ~F.col("lang").isin(*_CASED))
    after = s.join(F.broadcast(abbrev), ["lang", "a"], "left_semi").join(F.broadcast(start.withColumn("starts", F.lit(True))), ["lang", "w"], "left")
    after = after.groupBy("lang", "a").agg(F.sum(F.when(opener, F.col("n")).otherwise(0)).alias("o"), F.sum("n").alias("n"))
    model.abbrev -= {(r[0], r[1]) for r in after.where(F.col("o") >= END_SHARE * F.col("n")).collect()}
    abbrev = docs.sparkSession.createDataFrame([*model.abbrev] or [("", "")], "lang string, a string")

    # collocations over a period: the next type comes more often than it does after periods at large
    pair = s.groupBy("lang", "a", "w").agg(F.sum("n").alias("n"))
    nexts, alls = pair.groupBy("lang", "w").agg(F.sum("n").alias("nw")), {r[0]: r[1] for r in pair.groupBy("lang").agg(F.sum("n")).collect()}
    heads = pair.groupBy("lang", "a").agg(F.sum("n").alias("na"))
    known = pair.join(F.broadcast(abbrev), ["lang", "a"], "left_semi").join(F.broadcast(start), ["lang", "w"], "left_semi")
    # a word that is no abbreviation by itself, for it is used without a period too ("no"), may be one before numbers
    numbered = pair.where("w = '##number##' AND a NOT IN ('##number##', '##end##') AND n >= 3").join(F.broadcast(abbrev), ["lang", "a"], "left_anti")
    held = known.unionByName(numbered).join(nexts, ["lang", "w"]).join(heads, ["lang", "a"])

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, na, nw = (f[c].to_numpy(float) for c in ("n", "na", "nw"))
            size = np.array([alls[x] for x in f["lang"]], float)
            enough = np.where(f["w"] == "##number##", n >= NUMBER_SHARE * na, n * 10 >= na) & (n >= LEAST_SHARE * size)
            yield f.loc[enough & (n * size > 3 * na * nw) & (llr(n, na, nw, size) >= COLLOCATION_LLR), ["lang", "a", "w"]]

    # a paragraph of Latin letters in no known language, or in one of which there is little, is treated as in any of the others
    most = max([n for x, (n, _) in totals.items() if x in FUNCTION_WORDS] or [0])
    poor = [x for x, (n, _) in totals.items() if (x in FUNCTION_WORDS or x == "latin") and n < 0.02 * most or x == "latin"]
    rich = [x for x in totals if x in FUNCTION_WORDS and x not in poor]
    for known in (model.abbrev, model.starters):
        every = {w for x, w in known if x in rich}
        known.difference_update([(x, w) for x, w in known if x in poor])
        known.update((x, w) for x in {*poor, "latin"} for w in every)
    model.bound = {tuple(r) for r in held.mapInPandas(bound, "lang string, a string, w string").collect()}
    model.bound |= {(x, a, w) for x in {*poor, "latin"} for y, a, w in [*model.bound] if y in rich and w == "##number##"}
    return model


_SPACE = re.compile(r"\s*")


def ends(text: str, model: Model) -> list[int]:
    """End of each sentence of text, in code points from its beginning."""
    out: list[int] = []
    for p, q in paragraphs(text):
        par = text[p:q]
        lang = language(par)
        begin, size = 0, q - p
        gap, seen = -1, 0
        for m in MARK.finditer(par):
            e = m.end()
            if e >= size:
                break
            mark = m.group()
            c = mark[0]
            at = _SPACE.match(par, e).end()
            if at >= size:
                break
            n0 = par[at]
            closed = mark[-1] in CLOSERS
            if c in DENSE:
                if closed and mark[-1] in "”」』’":
                    if lang == "ja":
                        if n0 in _JA_ON:
                            continue
                    elif par[_SPACE.match(par, begin).end()] in "“‘「『" and _ZH_SPEECH.match(par, at):
                        continue
                if n0 in CLOSERS + ",，、;；":
                    continue
                out.append(p + e)
                begin = e
                continue
            if n0 in CLOSERS + ",;:—–،؛" or (n0 == "-" and par[at + 1 : at + 2] == " "):
                continue
            k = at
            while k < size and par[k] in OPENERS + "-—–":
                k += 1
            if par[k : k + 1].islower():
                continue
            if c == "." and len(mark.rstrip(CLOSERS + "   »")) == 1 and not (closed and mark[-1] not in ")]"):
                j = m.start()
                gap, seen = _last_gap(par, seen, j, gap), j
                if _ENUM.match(par, begin, j + 1):
                    continue
                a = word_type(par[gap + 1 : j + 1])
                if a != "##number##":
                    known = (lang, a) in model.abbrev
                    if not known and len(a) == 1 and a.isalpha():
                        known = True
                    if not known and "-" in a and all(len(x.rstrip(".")) == 1 for x in a.split("-")):
                        known = True
                    if not known and "'" in a or "’" in a:
                        known = known or (lang, re.split("['’]", a)[-1]) in model.abbrev
                    w = word_type(_TOKEN.match(par, at).group())
                    if not known and w == "##number##" and (lang, a, w) in model.bound:
                        continue
                    if known:
                        if gap < begin and (lang, a) in model.abbrev:  # an abbreviation alone is no sentence
                            continue
                        if w == "##number##" or (lang, a, w) in model.bound or (lang, w) not in model.starters:
                            if n0 not in "“«¿¡‘(":
                                continue
                            k = at
                            while k < size and par[k] in OPENERS:
                                k += 1
                            if k == size or par[k].isdigit():
                                continue
            out.append(p + e)
            begin = e
        out.append(q)
    return out


def split_sentences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sent_no, begin_pos, end_pos) for each sentence of docs (doc_id, text; other columns aren't read).

    Positions count code points; white space belongs to no sentence. Null, empty and blank texts have none. Repeated texts each
    get their own. Texts are never cut, however long. The model is learnt from docs if none is given.
    """
    if model is None:
        model = learn(docs)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        for f in frames:
            ids, nos, begins, stops = [], [], [], []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                at = 0
                for k, e in enumerate(ends(text, m)):
                    while text[at].isspace():
                        at += 1
                    ids.append(doc_id)
                    nos.append(k)
                    begins.append(at)
                    stops.append(e)
                    at = e
            yield pd.DataFrame({"doc_id": ids, "sent_no": nos, "begin_pos": begins, "end_pos": stops})

    return docs.where("text IS NOT NULL AND text != ''").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, sent_no int, begin_pos bigint, end_pos bigint")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return split_sentences(table(spark, root, "documents")).select("doc_id", "end_pos")


def p10_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Per document its number of sentences and the length of the longest."""
    s = split_sentences(table(spark, root, "documents"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.col("end_pos") - F.col("begin_pos")).alias("longest"))


QUERIES = {"p10_found": p10_found, "p10_sizes": p10_sizes}
SQL: dict[str, str] = {}
