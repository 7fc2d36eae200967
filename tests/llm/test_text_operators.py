import random

import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import leakage as L
from citeloom.llm import mixing as M
from citeloom.llm import residue as R
from citeloom.llm import scan_repair as P
from citeloom.llm import sentences as S
from citeloom.llm import subjects as A
from citeloom.llm.boosting import Boosted
from citeloom.llm.fmindex import FIRST, SEP, FMIndex


def test_fm_index_finds_every_occurrence():
    r = np.random.default_rng(2)
    docs = [r.integers(FIRST, FIRST + 5, r.integers(1, 60)) for _ in range(30)]
    docs += [docs[0], docs[0], np.full(40, FIRST)]
    sym = np.concatenate([np.append(d, SEP) for d in docs]).astype(np.int64)
    ix = FMIndex(sym, FIRST + 5)
    grams = np.array([[a, b, c] for a in range(FIRST, FIRST + 5) for b in range(FIRST, FIRST + 5) for c in range(FIRST, FIRST + 5)])
    lo, hi = ix.search(grams)
    for g, a, b in zip(grams, lo, hi):
        got = sorted(ix.locate(np.arange(a, b)).tolist())
        assert got == [i for i in range(len(sym) - 2) if (sym[i : i + 3] == g).all()]


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def holds(item, doc):
    n = len(item)
    least = -(-n * 6 // 10)
    for i in range(n):
        for m in range(least, n - i + 1):
            e = m // 8
            for k in range(max(1, m - e), m + e + 1):
                if any(lev(item[i : i + m], doc[j : j + k]) <= e for j in range(len(doc) - k + 1)):
                    return True
    return False


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    vocab = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([6, 14, 17])))) for k in range(6)] + [(98, ""), (99, None)]
    docs = []
    for k in range(60):
        w = [r.choice(vocab) for _ in range(12)]
        it = items[k % 6][1].split()
        part = it[: int(len(it) * r.choice([0.4, 0.55, 0.65, 0.8, 1.0]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            q = r.randrange(len(part))
            part = r.choice([part[:q] + part[q + 1 :], [*part[:q], "zz", *part[q:]], [*part[:q], "yy", *part[q + 1 :]]])
        docs.append((k, " ".join(w[:6]) + ", " + " -- ".join(part).upper() + "\n" + " ".join(w[6:])))
    docs += [(70, None), (71, ""), (72, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    leaks = L.find_leaks(df, it, shard_words=300, item_block=4)
    got = {(x["doc_id"], x["item_id"]) for x in leaks.collect()}
    want = {(d, i) for d, t in docs if t for i, u in items if u and holds(L.words(u), L.words(t))}
    assert got == want
    assert L.removal_spans(leaks).where("begin_pos >= end_pos").count() == 0
    assert L.find_leaks(df, it.limit(0)).count() == 0 and L.find_leaks(df.limit(0), it).count() == 0


def test_mixture_meets_shares_and_caps(spark):
    r = random.Random(1)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(1, 60))), s) for k in range(900) for s in [r.choice(["Big one", "big-one ", "SMALL", "tiny"] if k % 9 else ["unlisted", None])]]
    docs += [(2000, None, "tiny"), (2001, "", "tiny")]
    t = spark.createDataFrame([("big_one", 0.4, 1), ("small", 0.35, 3), ("tiny", 0.2, 1), ("none", 0.05, 5)], "source_name string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("key", F.lit("clash")).withColumn("slot", F.lit(1))
    plan, report = M.mix(d, t, block_tokens=64)
    rep = {x["source_name"]: x for x in report.collect()}
    assert not rep["none"]["reachable"] and rep["none"]["size"] == 0 and rep["big_one"]["reachable"]
    assert plan.groupBy("doc_id").agg(F.count_distinct("use_no").alias("n")).agg(F.max("n")).first()[0] <= 3
    # a use of a document is taken once, in pieces that follow each other; a source's slots but its last hold exactly a block
    whole = plan.groupBy("doc_id", "use_no").agg(F.sum("n_tokens").alias("n"), F.min("from_token").alias("lo"), F.max(F.col("from_token") + F.col("n_tokens")).alias("hi"))
    assert whole.where("hi - lo != n").count() == 0 and whole.where("lo > 0").count() <= 3
    full = plan.groupBy("source_name", "slot").agg(F.sum("n_tokens").alias("n"))
    assert full.where("n > 64").count() == 0 and full.where("n < 64").count() <= 3
    assert all(x["reachable"] == x["supply_suffices"] for x in rep.values())
    reached = [x for x in rep.values() if x["reachable"]]
    for x in reached:
        assert abs(x["used"] - x["wanted"]) < 0.1 * x["wanted"] + 200
    first = plan.where("slot < 32").groupBy("source_name").agg(F.count_distinct("slot").alias("n"))
    assert abs({x["source_name"]: x["n"] for x in first.collect()}["big_one"] - 12.8) <= 1.5
    assert M.mix(d.limit(0), t)[0].count() == 0


def test_sentences(spark):
    base = ["Mr. Tax met Mrs. Lund at 10.30 a.m. in room No. 4. The vote was taken. It cost 2.5 crowns.", "He said so. Dr. Vel left. Mr. Orn came. The list is open. The text was read by Mr. Kel.", "No. 5 was read. The art. 7 and art. 8 were kept, cf. doc. 9. The chair left."]
    docs = [(k, base[k % 3]) for k in range(300)]
    probe = {1000: ("Heading without stop\n\nMr. Tax left. “Is it done?” asked Mrs. Lund. (It was.)  \n", ["Heading without stop", "Mr. Tax left.", "“Is it done?” asked Mrs. Lund.", "(It was.)"]),
             1001: ("塔斯凯先生说：“我们还没有完成。”大会通过了名单，比例升至24.32%！（已结束。）", ["塔斯凯先生说：“我们还没有完成。”", "大会通过了名单，比例升至24.32%！", "（已结束。）"]),
             1002: ("委員は「準備はできたか？」と尋ねた。総会は終わった。", ["委員は「準備はできたか？」と尋ねた。", "総会は終わった。"]),
             1003: ("सभा ने सहमति दी। क्या वह तैयार है?", ["सभा ने सहमति दी।", "क्या वह तैयार है?"]),
             1004: ("4. Invites all\nmembers to come;\n\nThe chair paused ... and left.", ["4. Invites all\nmembers to come;", "The chair paused ... and left."]),
             1005: ("   \n ", []), 1006: ("", []), 1007: (None, [])}
    df = spark.createDataFrame(docs + [(k, v[0]) for k, v in probe.items()], "doc_id long, text string").withColumn("sent_no", F.lit("clash"))
    out = {}
    for x in S.split_sentences(df).orderBy("doc_id", "sent_no").collect():
        out.setdefault(x["doc_id"], []).append((x["begin_pos"], x["end_pos"]))
    for k, (t, want) in probe.items():
        assert [t[a:b] for a, b in out.get(k, [])] == want, k
    assert [base[0][a:b] for a, b in out[0]] == ["Mr. Tax met Mrs. Lund at 10.30 a.m. in room No. 4.", "The vote was taken.", "It cost 2.5 crowns."]
    assert S.split_sentences(df.limit(0)).count() == 0


def test_wide_spaces_after_a_mark_lose_no_sentence():
    gap = " " * 60
    text = f"The vote was taken.{gap}The list is open.\n{gap}The text was read."
    cuts = [0, *S.ends(text, S.Model())]
    assert [text[a:b].strip() for a, b in zip(cuts, cuts[1:])] == ["The vote was taken.", "The list is open.", "The text was read."]


def test_numbers_after_words_other_scripts_and_long_tokens(spark):
    base = ["No vote was taken. See item No. 4 of the list. The list is open.", "So was No. 9. The chair said no. No member left.", "The room is No. 12 of the house. There was no. The end."]
    docs = [(k, base[k % 3] + " It cost two crowns. The vote was long. He left at noon. The text was read. All members came. The house was full.") for k in range(300)] + [(k, "Ο κ. Παπάς ήρθε. Η σύνοδος έληξε. Είδε τον κ. Λάμπρου.") for k in range(300, 400)]
    long_ = "x" * 5_000
    probe = {1000: ("So was No.\u00a09. The end.", ["So was No.\u00a09.", "The end."]), 1001: ("Είδε τον κ. Λάμπρου. Η σύνοδος έληξε.", ["Είδε τον κ. Λάμπρου.", "Η σύνοδος έληξε."]),
             1002: (f"It was {long_}. {long_.upper()} came.\tThe end.", [f"It was {long_}.", f"{long_.upper()} came.", "The end."]), 1003: ("안녕하세요. 반갑습니다.", ["안녕하세요.", "반갑습니다."])}
    df = spark.createDataFrame(docs + [(k, v[0]) for k, v in probe.items()], "doc_id long, text string")
    out = {}
    for x in S.split_sentences(df).where("doc_id >= 1000").orderBy("doc_id", "sent_no").collect():
        out.setdefault(x["doc_id"], []).append((x["begin_pos"], x["end_pos"]))
    for k, (t, want) in probe.items():
        assert [t[a:b] for a, b in out[k]] == want, k
    assert S.ends("a.(" * 40_000 + "b", S.Model())[-1] == 120_001


def test_residue(spark):
    body = "The assembly took note of the coral nursery and asked the wardens to keep the list of reefs under review until the next session of the board."
    rows = [(0, "Convention on the coral nursery", "https://h/coral-nursery", "Adopted in 1950", body), (1, "T one", "https://h/t", None, "Error 404\nThe page you were looking for does not exist."),
            (2, "T two", "https://h/t", "ERROR", None), (3, "T three", "https://h/t", "Adopted [[date]]", body), (4, "T four", "https://h/t", None, "Veuillez activer JavaScript pour afficher le contenu."),
            (5, "Convention on the coral nursery", "u", None, body + " Service of the coral nursery may be temporarily unavailable; an error of judgement is no error 404."), (6, "x", "u", None, "Quib nimbre sat olorem tavelum plerra morun fustul prasim dosim ordeco velta gravem."),
            (7, None, None, None, None), (8, "x", None, "", ""), (9, "y", "u", None, "Press & hold to confirm you are a human (and not a bot)."), (10, "z", "u", None, body + " Set {a, b} of the annex [and the list].")]
    df = spark.createDataFrame(rows, "ord long, title string, url string, adopted_by string, content string").withColumn("body", F.lit("clash"))
    assert sorted(r["ord"] for r in R.find_residue(df).collect()) == [1, 2, 3, 4, 6, 9]
    assert R.find_residue(df.limit(0)).count() == 0


def test_residue_of_any_length_and_evidence_of_hosts(spark):
    error = "Error 404: the page you were looking for does not exist. Contact the administrator and retry after a while. Request id 8f03-11a2."
    real = "The wardens of Morvia asked that the coral nursery be kept under review, and the harbour board sent {k} divers to it. "
    rows, want = [], set()
    for k, n in enumerate((50, 100, 300)):
        rows.append((k, f"Title of number {k}", f"https://a/{k}", None, " ".join([error] * (n // 20))))
        rows.append((10 + k, f"Title of number {k}", f"https://a/{k}", None, "Please enable JavaScript in your browser.\n" * (n // 6)))
        text = " ".join(real.format(k=j) for j in range(n // 20))
        rows.append((20 + k, "Convention on coral nurseries", f"https://a/{k}", None, text + " An error of judgement is no error 404, and the page was not found in 12 houses."))
        rows.append((30 + k, "x", f"https://a/{k}", "Adopted on 3 May 1950 " + text + " with no access denied", text))
        want |= {k, 10 + k}
    # a menu line of one host: alone on a page it is no content there, on another host it is a page's own line
    menu = "Texts of the archive and of its branches in all six sectors"
    rows += [(100 + k, f"Reefs {k}", f"https://b/reefs-{k}", None, f"{menu}\n{real.format(k=w)}") for k, w in enumerate("six ten few two no old".split())]
    rows += [(110, "Tides", "https://b/tides", None, f"{menu}\n{menu}"), (111, "Tides", "https://c/tides", None, f"{menu}\n{menu}")]
    # one body under many titles of a host speaks of none of them; under titles of other hosts it is a text of its own
    rows += [(120 + k, f"Statute {w}", f"https://d/statute-{w}", None, "for details see the list kept with the papers of this house on its second floor") for k, w in enumerate(("salt", "wheat", "rope"))]
    rows += [(130 + k, f"Statute {w}", f"https://{w}/statute-{w}", None, "for details see the list kept with the papers of this house on its first floor") for k, w in enumerate(("salt", "wheat", "rope"))]
    rows += [(None, "x", "u", "ERROR", None), (1, "Title of number 1", "https://a/1", None, " ".join([error] * 5))]
    df = spark.createDataFrame(rows, "ord long, title string, url string, adopted_by string, content string").withColumn("host", F.lit("clash"))
    got = {(r["ord"], r["reason"]) for r in R.find_residue(df).collect()}
    assert {o for o, _ in got} == want | {110, 120, 121, 122}, sorted(got)


def test_detectors_find_what_their_patterns_find():
    from citeloom.llm.literals import needed_literals

    assert needed_literals(r"\b(?:not found|gone)\b x?") == {"not found", "gone"} and needed_literals(r"a?\d+") == set()
    r = random.Random(3)
    texts = ["Page not found", "Reference: ab12cd34", "NET::ERR_TIMED", "xxx xx xx", "502 Bad gateway", "tbd", "the wardens met", "Vérifiez; activez le JavaScript svp", "ПОЖАЛУЙСТА, ВКЛЮЧИТЕ JAVASCRIPT"]
    for patterns, d in zip((R.FILLER, [*R.ERRORS, *R.NOTICES, *R.MARKS]), R.detectors()):
        plain = [R.re.compile(p, R.re.I) for p in patterns]
        for t in texts + [" ".join(r.sample("error page you requested has been moved lorem ipsum script robot human verify 404 enable".split(), 5)) for _ in range(300)]:
            assert d.finds(t) == any(p.search(t) for p in plain), t


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(rounds=40, depth=3).fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def corpus(seed=5, n=240):
    """Rows with pages, headers, broken and misread words, and what is wrong where."""
    r = random.Random(seed)
    words = "assembly decides that members should consider report without further debate session member country working group council harvest irrigation canal treaty tribunal customs union vessel research station nursery record authority convinced review".split()
    rows, truth = [], set()
    for o in range(n):
        paras = [" ".join(r.choice(words) for _ in range(22)).capitalize() + r.choice([",", ";", "."]) for _ in range(5)]
        title = f"Situation of the {r.choice(words)} {r.choice(words)}"
        lines = []
        for p in paras:
            cur = ""
            for w in p.split():
                if len(cur) + len(w) > 56:
                    lines.append(cur)
                    cur = w
                else:
                    cur = f"{cur} {w}".strip()
            lines += [cur, ""]
        if o % 2:
            page = r.randrange(20, 90)
            out, k = [], 0
            for line in lines:
                if k and k % 7 == 0:
                    truth.add((o, len(out), "page_no"))
                    out.append(f"- {page} -")
                    truth.add((o, len(out), "header"))
                    out.append(f"Assembly — {r.choice(['Fourth', 'Ninth'])} session")
                    page += 1
                ws = line.split()
                if len(ws) > 4 and r.random() < 0.2:
                    j = r.randrange(1, len(ws) - 1)
                    if "e" in ws[j][1:] and len(ws[j]) > 5:
                        ws[j] = ws[j][0] + ws[j][1:].replace("e", "c", 1)
                        truth.add((o, len(out), "misread"))
                if ws and len(ws[-1]) > 8 and r.random() < 0.5 and ws[-1].isalpha():
                    out.append(" ".join([*ws[:-1], ws[-1][:4] + "-"]))
                    truth.add((o, len(out) - 1, "hyphen"))
                    out.append(ws[-1][4:] + " and so on until the end of it")
                else:
                    out.append(" ".join(ws))
                k += 1
            lines = out
        rows.append((o, title, "\n".join(lines)))
    return rows, truth


def test_scan_repair_on_planted_pages(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([*rows, (900, None, None), (901, None, ""), (902, "t", "One line.")], "ord long, title string, content string").withColumn("line_no", F.lit("clash"))
    got = {(r["ord"], r["line_no"], r["kind"]) for r in P.repair(df).parts.collect()}
    for kind, recall, precision in (("header", 0.95, 0.95), ("page_no", 0.95, 0.95), ("hyphen", 0.9, 0.9), ("misread", 0.85, 0.85)):
        g, t = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(g & t) >= recall * len(t) and len(g & t) >= precision * len(g), (kind, len(g), len(t), len(g & t), sorted(g - t)[:5], sorted(t - g)[:5])


def test_repaired_text_has_paragraphs_without_furniture(spark):
    rows, _ = corpus()
    scan = "   Decides that members should consider the tribunal and the council\nwithout furthcr dcbate, and that the harvest\n\n- 41 -\nAssembly — Fourth session\n\nshould be a group (working) mem-\nbcr of the auth-\n- 42 -\nAssembly — Fourth session\nority;\n   Assembly record reported to the customs union by two- and three-way mem-\nbers."
    rows += [(901, "t", scan), (902, "t", ""), (903, "t", None)]
    df = spark.createDataFrame(rows, "ord long, title string, content string").withColumn("text", F.lit("clash"))
    scanned = P.repair(df)
    out = {r["ord"]: r["text"] for r in P.texts(df, scanned).collect()}
    assert len(out) == len(rows) and out[902] == "" and out[903] is None
    assert out[901].split("\n\n") == ["Decides that members should consider the tribunal and the council without further debate, and that the harvest should be a group (working) member of the authority;",
                                      "Assembly record reported to the customs union by two- and three-way members."]
    assert ("membcr", "member") in {(r["w"], r["fix"]) for r in scanned.fixes.collect()}
    assert {(r["a"], r["b"]) for r in scanned.joins.where("ord = 901 AND vanish").collect()} == {("mem", "bcr"), ("auth", "ority"), ("mem", "bers")}
    assert P.repaired(None, "by group-\nand council-wide", [(0, "hyphen", "group", None, 1)]) == "by group- and council-wide"


def test_rare_misreads_of_rows_without_furniture_are_found(spark):
    rows, _ = corpus()
    rows += [(910, "t", "Members should consider the rcport."), (911, "t", "The asscmbly went into dcbate."), (912, "t", "Members should consider the dcbate.")]
    df = spark.createDataFrame(rows, "ord long, title string, content string")
    scan = P.repair(df)
    assert {(r["ord"], r["line_no"], r["kind"]) for r in scan.parts.where("ord >= 910").collect()} == {(k, 0, "misread") for k in (910, 911, 912)}
    assert {("rcport", "report"), ("asscmbly", "assembly"), ("dcbate", "debate")} <= {(r["w"], r["fix"]) for r in scan.fixes.collect()}


def test_long_lines_words_and_joints_are_read_whole():
    long_ = "w" * 60 + "commodity"
    lines = ["x " * 400 + "auth-", "ority of the " + long_, "A" * 500 + "-", "end"]
    p = P.parse([("t", "\n".join(lines))], P.fit_lines([("t", "a\nb")]))[0]
    assert [(j[0], j[3], j[4]) for j in p.joints] == [(0, 1, "ority"), (2, 3, "end")] and p.joints[0][1] == "auth" and p.joints[1][1] == "a" * 500
    assert P.distance("w" * 2_000 + "cornmodity", "w" * 2_000 + "commodity")[0] == 0.2
    known = [([3.0, 0.0, 1.0, 0.0, 0.0, 5, 4, 1.0, 0.0], True), ([0.0, 3.0, 4.0, 4.0, 0.0, 5, 4, 0.0, 0.0], False)] * 200
    joints = P.fit_joints(known)
    assert (joints.predict(np.array([known[0][0], known[1][0]])) >= 0.5).tolist() == [True, False]


def test_subjects_held_out(spark):
    r = random.Random(2)
    vocab = {"sea": "anchor harbour vessel reef tide sailor mast cargo".split(), "farm": "barley plough harvest cattle orchard fodder silo meadow".split(), "law": "tribunal verdict statute bench appeal notary decree clause".split()}
    say = lambda ws: f"Convinced that the {r.choice(ws)} and every {r.choice(ws)} of the members should keep the {r.choice(ws)} under review,"
    dull = "Takes note of the letter circulated before the opening of the session by the officers,"
    samples = [(a, " ".join(say(ws[:5]).replace(",", ".") for _ in range(3))) for a, ws in vocab.items() for _ in range(12)]
    docs, want = [], set()
    for o in range(300):
        a, b = r.sample(sorted(vocab), 2)
        n = r.choice([0, 1, 4])
        ps = [say(vocab[a]) for _ in range(6 if n != 4 else 4)] + [say(vocab[b]) for _ in range(n)] + [dull] * 3
        r.shuffle(ps)
        if o % 10 == 0:
            ps = [dull] * 6
        else:
            want |= {(o, a)} | ({(o, b)} if n == 4 else set())
        docs.append((o, f"Question of the {r.choice(vocab[a])}", "\n".join(ps)))
    df = spark.createDataFrame([*docs, (900, None, None), (901, None, "")], "ord long, title string, content string").withColumn("area", F.lit("clash"))
    s = spark.createDataFrame(samples, "area string, text string")
    got = {(x["ord"], x["area"]) for x in A.assign_areas(df, s).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert A.assign_areas(df, s.limit(0)).count() == 0
