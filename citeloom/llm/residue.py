"""Problem 7: template residue, filler, error pages and notices in place of real content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.literals import needed_literals
from citeloom.runtime import materialize, table

#: Notations of placeholders that a template engine or an editor should have filled.
_FIELD = r"[\w .:\-]{1,60}?"
PLACEHOLDERS = [
    r"\{\{\s*" + _FIELD + r"\s*\}\}", r"\{%\s*" + _FIELD + r"\s*%\}", r"[$#]\{\s*" + _FIELD + r"\s*\}", r"\[\[\s*" + _FIELD + r"\s*\]\]", r"<<\s*" + _FIELD + r"\s*>>",
    r"@@\s*" + _FIELD + r"\s*@@", r"(?<!\w)__[A-Za-z][\w .\-]{0,60}?__(?!\w)", r"(?<![\w%])%[A-Za-z][A-Za-z_. ]{1,40}%(?![\w%])", r"\bXX [\w .\-]{1,40}? XX\b",
    r"(?i:<\s*(?:insert|enter|add|your)\b[^<>\n]{1,60}>)", r"\[\s*(?:INSERT|ENTER|ADD|YOUR)\b[^\[\]\n]{1,60}\]", r"(?i:\[[^\[\]\n]{0,60}\bto be (?:confirmed|added|completed|inserted|determined)\s*\])",
    r"(?i:\[\s*(?:lorem|filler|dummy|sample|placeholder)\b[^\[\]\n]{0,60}\])", r"(?i:\[\s*(?:tbc|tbd|todo|placeholder)[^\[\]\n]{0,40}\])", r"(?i:[«\[(<{][^»\])>}\n]{0,60}(?:à compléter|a completar|por completar|zu ergänzen|to be filled(?: in)?|fill in|заполнить|待填|يستكمل)\s*[»\])>}])",
]
#: What filler and sample text says.
FILLER = [
    r"\blorem ipsum\b", r"\b(?:your|sample|dummy|placeholder|example) (?:text|content|paragraph|title)\b", r"\b(?:text|content) (?:goes )?here\b", r"\bexample page\b", r"\bedit or delete (?:it|this)\b",
    r"\bplaceholder for the\b", r"\bwill be (?:placed|inserted|added|shown) here\b", r"^\W*(?:test\W+)*test\W*$", r"\badd your \w+", r"\bclick (?:here )?to (?:edit|add)\b", r"\buntitled (?:section|page|document)\b", r"^\W*(?:tbd|tbc|todo|fixme|n/?a|xxx+|test|testing|none|null|nan|undefined|coming soon|under construction)\W*$",
    r"^\W*(?:(?:undefined|nan|null|none|object object)\W+)+(?:undefined|nan|null|none|object object)\W*$", r"^\W*(?:insert|enter|type|write|add) (?:a|an|the|your|some) (?:\w+ ){0,3}(?:paragraph|text|title|summary|description|content|name|date)\b.{0,40}$", r"\b(?:asdf|qwer|zxcv|hjkl|sdfg)\w*\b", r"\bx{3,}(?:\s+x{2,})+\b", r"\bthis (?:page|section) is (?:under construction|a stub|empty|left blank)\b", r"\bjust another \w+ site\b", r"\bhello world\b",
]
#: What servers, browsers and guards say instead of a page.
_THING = r"(?:page|file|resource|document|address|url|link|site|website|content|article|item|server|origin)"
ERRORS = [
    r"^\W*[1-5]\d\d\b(?:\W*$|.{0,40}\b(?:not found|forbidden|error|unavailable|gateway|many|gone|time-?out|unauthori[sz]ed|bad|denied)\b)", r"\b(?:http|status(?: code)?|error|erreur|fehler|erro|ошибка|код)\W{0,3}(?:code\W{0,2}|no\W{0,2}|№\W{0,2})?[1-5]\d\d\b", r"خطأ\W{0,3}[1-5]\d\d",
    r"\b(?:not found|forbidden|unauthori[sz]ed|service (?:temporarily )?unavailable|too many requests|bad gateway|bad request|gone|internal server error|server error|gateway time-?out|request time-?out)\b(?:\W{0,3}\(?\[?[1-5]\d\d\b)?(?=\W|$)",
    rf"\b{_THING}\b.{{0,40}}\b(?:requested|asked for|looking for|tried to (?:open|reach|view)|want(?:ed)?)\b.{{0,20}}\b(?:is|was|were|has|have|no longer|could|can(?:not)?|does|did|doesn't|isn't|can't)\b",
    rf"\b{_THING}\b.{{0,20}}\b(?:no longer exists?|does not exist|doesn't exist|not available|cannot be (?:displayed|found|shown|loaded|reached)|could not be (?:displayed|found|shown|loaded|reached)|has been (?:moved|removed|deleted)|seems to be broken)\b",
    r"\b(?:the|this|that) \w+ (?:that )?you (?:have )?(?:requested|asked for|were looking for|are looking for|tried to (?:open|reach|view))\b", r"\b(?:couldn't|could not|can't|cannot) find (?:that|the|this) \w+\b", r"\b(?:check the address and try again|please try again|try again later|return to the home page|go back to the home page|contact the administrator|retry after)\b", r"\b(?:request id|reference)\W{1,3}[0-9a-f#\-]{6,}",
    r"\bsomething went wrong\b", r"\bsession (?:has )?(?:expired|timed out)\b", r"\b(?:sign|log) in (?:again )?to (?:view|continue|see)\b", r"\b(?:down|closed|offline) for (?:scheduled |planned )?maintenance\b", r"\bdatabase connection\b",
    r"\bconnection (?:was )?(?:refused|reset|timed out|closed)\b", r"\bupstream connect error\b", r"\b(?:requested )?url was rejected\b", r"\bsupport id\b", r"\brate[- ]limited\b", r"\bthe origin did not answer\b", r"\bour team has been (?:told|notified)\b",
    r"\baccess (?:to this (?:page|site|resource) )?(?:has been |was |is )?(?:denied|blocked|restricted)\b", r"\byou (?:have been|are|were) (?:blocked|denied|banned)\b", r"\btemporarily (?:unavailable|down|out of service|closed)\b",
    r"\bpage (?:introuvable|non trouvée|inexistante)\b", r"\bla page demandée\b", r"\baccès (?:refusé|interdit)\b", r"\berreur (?:du serveur|interne)\b", r"\bservice (?:temporairement )?indisponible\b", r"\berror (?:del|interno del) servidor\b", r"\bpágina (?:no encontrada|solicitada|inexistente)\b", r"\bno se (?:ha podido|pudo|encuentra|encontró)\b", r"\bacceso denegado\b",
    r"\bseite (?:wurde )?nicht gefunden\b", r"\bzugriff verweigert\b", r"\bpágina não encontrada\b", r"\bpagina non trovata\b", r"страница не найдена", r"доступ (?:запрещ[её]н|закрыт)", r"ошибка сервера", r"сервис (?:временно )?недоступен", r"صفحة غير موجودة", r"الصفحة غير", r"تم رفض الوصول", r"页面(?:不存在|未找到|无法)", r"找不到(?:该|您|网)?页", r"服务器(?:内部)?错误", r"拒绝访问", r"访问被拒绝", r"ページが見つかりません", r"アクセスが拒否", r"サーバー ?エラー", r"पृष्ठ नहीं मिला", r"त्रुटि \d",
]
_SCRIPTS = r"(?:java ?scripts?|(?:client-side )?scripts?|scripting|js|cookies|noscript)"
NOTICES = [
    rf"\b(?:enable|activate|turn on|switch on|allow|requires?|needs?|must|without|support|run)\b.{{0,40}}\b{_SCRIPTS}\b", rf"\b{_SCRIPTS}\b.{{0,40}}\b(?:enabled?|required?|needed|disabled|turned off|switched off|activated|is off|must|benötigt|aktivieren|nécessaire|requis)\b",
    r"\b(?:activez|activer|active|activar|habilite|habilitar|attivare|ative)\b.{0,20}\bjavascript\b", r"\bjavascript\b.{0,40}\b(?:désactivé|deshabilitado|aktiviert|benötigt|erforderlich|abilitato)\b", r"(?:включите|включить|разрешите|требуется).{0,20}javascript", r"javascript.{0,20}(?:を有効|が必要|を有効に)", r"(?:启用|开启|打开|需要).{0,12}javascript", r"(?:تفعيل|تمكين|فعّل|يتطلب|بتفعيل).{0,20}(?:javascript|جافا ?سكر[يب]+ت)", r"javascript.{0,30}(?:सक्षम|चालू|आवश्यक)",
    r"\b(?:captcha|cloudflare|ddos protection)\b", r"\b(?:confirm|verify|prove|check|checking|make sure|ensure|establish)\b.{0,30}\b(?:human|robot|bot)\b", r"\b(?:not a (?:ro)?bot|you are (?:a )?human|are you (?:a )?(?:human|robot)|human verification|human check)\b", r"\bpress (?:&|and) hold\b", r"\b(?:security|browser) check\b", r"\b(?:checking|verifying) (?:your|the) (?:browser|connection|device)\b", r"\bautomat(?:ion tools|ed (?:access|requests|queries|traffic))\b", r"\bunusual traffic\b", r"\bjust a moment\b", r"\bverif(?:y|ication) (?:you|required|needed)\b", r"\btick the box\b",
    r"\b(?:vous êtes (?:un )?humain|n'êtes pas un robot)\b", r"\b(?:no (?:es|soy|eres) un robot|es (?:usted )?humano)\b", r"(?:вы не робот|что вы человек)", r"(?:人机验证|不是机器人|验证您是)", r"(?:ロボットではない|人間であること)", r"(?:لست روبوت|أنك إنسان)", r"(?:kein roboter|dass sie ein mensch)",
]
#: What a collector of pages leaves when it failed.
MARKS = [
    r"^\W*(?:security[_ ]?block(?:ed)?|error|failed|failure|blocked|timeout|timed out|no[_ ]?content|not[_ ]?available|fetch[_ ]?failed|scrape[_ ]?failed|access[_ ]?denied)\W*$", r"^\s*message:\s", r"\b\w*(?:timeout|nosuchelement|webdriver|staleelement|elementnot\w+|connection|http|url|ssl|attribute|value|type|key)(?:exception|error)\b\s*(?::|$)",
    r"\bunable to locate element\b", r"\btraceback \(most recent call last\)", r"\bstack ?trace:", r"\bno such element\b", r"\bnet::err_\w+", r"\b(?:max retries exceeded|read timed out)\b",
]
_PLACE = re.compile("|".join(PLACEHOLDERS))
_MAY_PLACE = re.compile(r"[{\[<@%«]|__|XX|\(")
#: Words that any sentence of some length holds, by language; filler has none of them.
COMMON = set("the of and to in that is was for with by on not from at which be as it are were has had a an or this its their shall le la les des du et un une dans pour que qui par sur au aux est el los del y en para con se su der die das und den von zu mit ist не в и на по с что к из о от за को के की में से और है का".split())
_WORD = re.compile(r"\w+")
_CASED = re.compile(r"[A-Za-zÀ-ɏ]{2,}")
_SENTENCE = re.compile(r"\n+|(?<=[.!?…。！？])\s+|\s\|\s")
_ADOPTED = re.compile(r"(?i)\W*(?:adopted|proclaimed|signed|opened|approved|entered)\b")
FEW_WORDS = 8  # so few words beside what detectors found are no content
SHORT_WORDS = 25  # nor are so few, or fewer than what was found, if none is on the subject and no sentence has a name
FURNITURE = 5  # titles of a host on whose pages a line stands beside others; from so many on it is the host's, not the page's
REPEATED = 3  # titles of a host that have one body
SALTS = 32  # tasks that the rows of one frequent line or body are dealt out to
#: The most frequent of COMMON; a passage with enough of these alone is no filler.
_OFTEN = (" the ", " of ", " and ", " to ", " in ", " for ")


class Detector:
    """Patterns, each searched for only in passages that hold one of the literals which any match of it must contain."""

    def __init__(self, patterns: list[str]) -> None:
        self.each = [re.compile(p, re.I) for p in patterns]
        asked: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            for w in needed_literals(p, re.I):
                asked.setdefault(w, []).append(k)
        self.bare = [x for k, x in enumerate(self.each) if not any(k in v for v in asked.values())]
        self.words = ahocorasick.Automaton()
        for w, ks in asked.items():
            self.words.add_word(w, (len(w), ks))
        self.words.make_automaton()

    def marks(self, low: str) -> list[tuple[int, list[int]]]:
        """Where in a lower-case text a literal begins and which patterns need it, in order of place."""
        return sorted((end - size + 1, ks) for end, (size, ks) in self.words.iter(low))

    def hit(self, passage: str, asked: set[int]) -> bool:
        return any(self.each[k].search(passage) for k in asked) or any(x.search(passage) for x in self.bare)

    def finds(self, text: str) -> bool:
        return self.hit(text, {k for _, ks in self.marks(text.lower()) for k in ks})


@lru_cache(1)
def detectors() -> tuple[Detector, Detector, Detector]:
    """Of filler; of errors, notices and marks; of marks alone."""
    return Detector(FILLER), Detector([*ERRORS, *NOTICES, *MARKS]), Detector(MARKS)


def _terms(*texts: str | None) -> set[str]:
    """Content words of title and address slug, cut to a stem of six letters."""
    out = set()
    for t in texts:
        for w in _WORD.findall((t or "").lower().replace("-", " ").replace("_", " ")):
            if len(w) > 3 and w not in COMMON and not w.isdigit():
                out.add(w[:6])
    return out


GENERIC = {w[:6] for w in "convention declaration principles protocol optional guidelines relating concerning instruments instrument texts text agreement treaty charter covenant rules statement".split()}


def is_filler(text: str) -> bool:
    """Whether a passage of eight or more Latin words has no common word of any language, or repeats a handful of words."""
    if text.count(" ") < 7:
        return False
    low = text.lower()
    if sum(low.count(w) for w in _OFTEN) > 0.02 * (text.count(" ") + 1):
        return False
    w = [x.lower() for x in _CASED.findall(text)]
    if len(w) < 8:
        return False
    common = sum(x in COMMON for x in w)
    return common == 0 or (common <= 0.02 * len(w) and len(set(w)) < 0.6 * len(w))


def _has_place(text: str) -> bool:
    """Whether a placeholder stands in the text; most texts hold none of the characters that one needs."""
    return _MAY_PLACE.search(text) is not None and _PLACE.search(text) is not None


def _speaks_of(low: str, topic: set[str]) -> bool:
    """Whether a word of a lower-case text begins with one of the stems."""
    for t in topic:
        at = low.find(t)
        while at >= 0:
            if at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_"):
                return True
            at = low.find(t, at + 1)
    return False


def _passages(text: str) -> Iterator[tuple[int, str]]:
    """(place, passage) of the sentences of a text, blank ones left out."""
    at = 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if (piece := text[at:end]).strip():
            yield at, piece
        at = m.end() if m else end


def _judged(text: str) -> list[tuple[str, bool, bool]]:
    """(passage, filler found, error or notice or mark found) of a text's sentences."""
    two = detectors()[:2]
    low, out = text.lower(), []
    if len(low) != len(text):  # a letter whose lower case is longer: places don't agree
        return [(x, *(d.finds(x) for d in two)) for _, x in _passages(text)]
    marks, at = [d.marks(low) for d in two], [0, 0]
    for begin, x in _passages(text):
        found = []
        for j, d in enumerate(two):
            asked: set[int] = set()
            while at[j] < len(marks[j]) and marks[j][at[j]][0] < begin + len(x):
                if marks[j][at[j]][0] >= begin:
                    asked.update(marks[j][at[j]][1])
                at[j] += 1
            found.append(d.hit(x, asked))
        out.append((x, *found))
    return out


def adopted_reason(text: str | None) -> str | None:
    """Why the field of adoption holds no real text, or None. A text of adoption may speak of errors among other things."""
    a = (text or "").strip()
    if not a:
        return None
    if _has_place(a):
        return "placeholder"
    said = _judged(a)
    if detectors()[2].finds(a):
        return "failure mark"
    bad = sum(len(x.split()) for x, f, b in said if f or b)
    left = sum(len(x.split()) for x, f, b in said if not (f or b))
    if bad and not _ADOPTED.match(a) and (left < FEW_WORDS or left < bad):
        return "failure mark"
    return None


#: Facts of a line: its number, words, words of filler, words of passages in which a detector hit; whether one hit, whether one
#: hit a passage that has no term of the subject, whether an error, notice or mark did, whether a passage without hits has a
#: term of the subject, whether such a passage names somebody or something.
LINE = "struct<k: int, words: int, filler: int, bad: int, hit: boolean, off: boolean, error: boolean, topic: boolean, named: boolean>"


def _named(passage: str) -> bool:
    """Whether a sentence has a name inside; a line of which most words are capitalised is a heading or a menu."""
    ws = [w for x in re.split(r"[.!?:]\s+", passage) for w in x.split()[1:]]
    names = sum(w[:1].isupper() and not w.isupper() for w in ws)
    return 0 < names <= 0.5 * len(ws) and len(ws) >= 4


def line_facts(title: str | None, url: str | None, content: str) -> list[tuple]:
    """The facts of each line that isn't blank; none for a page that speaks of its subject and in which nothing was found."""
    topic = _terms(title, (url or "").rstrip("/").rsplit("/", 1)[-1]) - GENERIC
    lines = content.split("\n")
    filler = [len(x.split()) if is_filler(x) else 0 for x in lines]
    out, said = [], []
    for x in lines:
        said.append(_judged(x))
    if not any(filler) and not any(f or b for ps in said for _, f, b in ps) and _speaks_of(content.lower(), topic):
        return []
    for k, (x, fill, ps) in enumerate(zip(lines, filler, said)):
        if not x.strip():
            continue
        hits = [(p, f or b, _speaks_of(p.lower(), topic)) for p, f, b in ps]
        out.append((k, len(x.split()), fill, sum(len(p.split()) for p, h, _ in hits if h), any(h for _, h, _ in hits), any(h and not t for _, h, t in hits), any(b for _, _, b in ps), any(t and not h for _, h, t in hits), any(_named(p) for p, h, _ in hits if not h)))
    return out


def _masked(c: Column | str) -> Column:
    """Lower case, numbers and hexadecimal codes as one sign."""
    return F.regexp_replace(F.lower(c), r"\b[0-9a-f]*\d[0-9a-f\-]*\b", "#")


def find_residue(pages: DataFrame) -> DataFrame:
    """(ord, reason) of the rows of pages (ord, title, url, adopted_by, content) without a real page.

    Three kinds of evidence are combined. Detectors find placeholders, filler, error pages, notices and failure marks, sentence by
    sentence. Each sentence is compared with the terms of the title and of the address's last part. Per host of the address it is
    counted how many titles have a line beside others (FURNITURE titles make it the host's own) and how many have the body (REPEATED titles make it
    a response that isn't the page's), numbers masked. A page is residue whose own lines hold a finding and beside it FEW_WORDS words
    at most, or nothing on the subject, no name and fewer words than what was found (SHORT_WORDS at least), however long it is; or that
    is all furniture; or that has a repeated body without a name or a term of its subject. A text that speaks of errors or scripts among
    other things of its subject is none. Null, empty and blank fields are no case. Rows without an address have one host, rows of
    null ord take no part, equal rows of one ord come out once.

    No text is shuffled: counts are of hashes, and after one pass over the texts only facts of lines travel, of the pages alone that
    a finding or a missing subject leaves open. Lines and bodies that many rows share are salted.
    """
    kind = pages.schema["ord"].dataType.simpleString()
    rows = pages.where("ord IS NOT NULL").select("ord", "title", "url", "adopted_by", "content")
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))
    hashed = F.transform(F.split(_masked("content"), "\n"), lambda x: F.xxhash64(F.trim(x)))
    src = rows.withColumns({"host": F.xxhash64(F.lower(host)), "head": F.xxhash64(F.trim(_masked(F.coalesce("title", F.lit(""))))), "hashes": hashed})
    src = src.withColumns({"page": F.xxhash64("title", "url", "adopted_by", "content"), "name": F.xxhash64("title")})

    per_line = src.where(F.size(F.array_distinct("hashes")) > 1).select("host", "name", F.explode(F.array_distinct("hashes")).alias("line")).distinct()
    furniture = per_line.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FURNITURE).select("host", "line", F.lit(True).alias("furniture"))
    body = F.xxhash64("hashes")
    bodies = src.where("content IS NOT NULL").select("host", "name", body.alias("body")).distinct().groupBy("host", "body").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATED).select("host", "body", F.lit(True).alias("repeated"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for o, t, u, a, c, page in zip(f["ord"], f["title"], f["url"], f["adopted_by"], f["content"], f["page"]):
                t, u, a, c = (x if isinstance(x, str) else None for x in (t, u, a, c))
                why = adopted_reason(a) or ("placeholder" if c and _has_place(c) else None)
                facts = line_facts(t, u, c) if why is None and c and c.strip() else []
                if why or facts:
                    out.append((o, page, why, facts))
            yield pd.DataFrame(out, columns=["ord", "page", "reason", "facts"])

    texts = src.select("ord", "title", "url", "adopted_by", "content", "page")
    open_ = materialize(texts.mapInPandas(run, f"ord {kind}, page bigint, reason string, facts array<{LINE}>").dropDuplicates(["ord", "page"]), "pages")
    narrow = src.select(F.col("ord").alias("__o"), F.col("page").alias("__p"), "host", "head", "hashes")
    undecided = open_.where("reason IS NULL").join(narrow, (F.col("ord") == F.col("__o")) & (F.col("page") == F.col("__p"))).drop("__o", "__p").dropDuplicates(["ord", "page"])
    salt = F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int")
    dealt = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    undecided = undecided.withColumn("salt", salt).withColumn("body", body).join(dealt(bodies), ["host", "body", "salt"], "left")
    lines = undecided.select("ord", "page", "host", "head", "repeated", "salt", "hashes", F.inline("facts"))
    lines = lines.withColumn("line", F.get("hashes", F.col("k"))).drop("hashes").join(dealt(furniture), ["host", "line", "salt"], "left")
    shared = F.coalesce("furniture", F.lit(False))
    own = ~(shared & ~F.col("hit")) & (F.col("line") != F.col("head"))
    total = lambda c: F.sum(F.when(own, F.col(c)).otherwise(0))
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    facts = lines.groupBy("ord", "page").agg(
        total("words").alias("size"), total("filler").alias("filler"), total("bad").alias("bad"), any_(own & F.col("off") | F.col("hit") & (shared | (F.col("words") < SHORT_WORDS))).alias("found"),
        any_("error").alias("error"), any_(own & F.col("topic")).alias("topic"), any_(own & F.col("named")).alias("named"), any_(own).alias("own"), any_(~shared).alias("unshared"), any_(F.col("repeated")).alias("repeated"))
    left = F.col("size") - F.col("bad")
    low = (left < FEW_WORDS) | (~F.col("topic") & ~F.col("named") & (left < F.greatest(F.lit(SHORT_WORDS), F.col("bad"))))
    reason = (F.when((F.col("filler") > 0) & (F.col("filler") >= 0.3 * F.col("size")), "filler").when(F.col("found") & low, F.when(F.col("error"), "error or notice").otherwise("filler"))
              .when(~F.col("own"), F.when(~F.col("unshared"), "no content")).when(F.col("repeated") & ~F.col("topic") & ~F.col("named"), "repeated response"))
    judged = facts.select("ord", reason.alias("reason")).where("reason IS NOT NULL")
    return open_.where("reason IS NOT NULL").select("ord", "reason").unionByName(judged)


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ohchr_instruments_detailed")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return find_residue(_pages(spark, root)).select("ord")


def p7_reasons(spark: SparkSession, root: str) -> DataFrame:
    return find_residue(_pages(spark, root)).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    """The rows with a real page or none at all."""
    pages = _pages(spark, root)
    return pages.join(find_residue(pages).select("ord"), "ord", "left_anti")


QUERIES = {"p7_found": p7_found, "p7_reasons": p7_reasons, "p7_clean": p7_clean}
SQL: dict[str, str] = {}
