import pytest
from pyspark.sql import functions as F

from citeloom.operators import graph as G
from citeloom.operators import textscan as S
from citeloom.operators import trainset as T
from citeloom.operators.conventions import parse_lines
from citeloom.sources.schemas import CITATION, RESOLUTION, texts

NODES = [("10/1", "10/1", "1955-01-01", "Alpha declaration"), ("20 a (x)", "20 (x)", "1960-01-01", "Beta covenant"), ("20 b (x)", "20 (x)", "1960-01-01", "Beta, part b"),
         ("30/1", "30/1", "1970-01-01", "recalls the ALPHA Declaration"), ("31/1", "31/1", "1954-01-01", "alpha declaration"), ("32/1", "32/1", "1955-01-01", "alpha declaration"),
         ("33/1", "33/1", "1971-01-01", "alpha declaration committee"), ("34/1", "34/1", "1972-01-01", "alpha declaration"), ("35/1", "35/1", "1973-01-01", None)]
GIVE = ["30/1", "31/1", "32/1", "33/1", "35/1"]


@pytest.fixture(scope="module")
def frames(spark):
    row = {c: None for c in RESOLUTION}
    nodes = spark.createDataFrame([tuple((row | {"res_id2": a, "res_id2_unlet": b, "date_p": d, "content": t, "res_letter": a.split()[1] if " a " in a or " b " in a else None})[c] for c in RESOLUTION) for a, b, d, t in NODES], texts(RESOLUTION))
    docs = nodes.where(F.col("res_id2").isin(GIVE)).select(F.col("res_id2").alias("giving"), F.col("content").alias("text"), F.to_date("date_p").alias("day"))
    known = spark.createDataFrame([(g, "20 (x)") for g in GIVE[:4]] + [("35/1", None)], "giving string, res_id string")
    return nodes, docs, known


def test_title_scan(spark, frames):
    nodes, docs, known = frames
    titles = spark.createDataFrame([("10/1", "Alpha declaration", "1955-01-01")], "res_id string, title string, day string").withColumn("day", F.to_date("day"))
    got = {(r["giving"], r["res_id"]) for r in S.title_scan(docs, known, titles).collect()}
    assert got == {("30/1", "10/1"), ("33/1", "10/1")}


def test_spec_scan_variants(spark, frames):
    nodes, docs, known = frames
    days = spark.createDataFrame([("10/1", "1955-01-01")], "res_id string, day string").withColumn("day", F.to_date("day"))
    spec = S.TitleSpec("10/1", ["alpha declaration"], avoid=["alpha declaration committee"], also_cite=["11/1"], expect_n=1)
    hits = S.spec_scan(docs, known, [spec], days)
    assert {(r["giving"], r["res_id"]) for r in hits.collect()} == {("30/1", "10/1"), ("30/1", "11/1")}
    assert S.accepted(hits, [spec]).count() == 2
    spec.expect_n = 2
    with pytest.raises(AssertionError):
        S.accepted(hits, [spec])
    with pytest.raises(Exception, match="null text"):
        S.spec_scan(docs, known, [S.TitleSpec("10/1", ["alpha"], match="regex")], days, strict=True).collect()
    denied = S.TitleSpec("10/1", ["alpha declaration"], deny=["30/1"], allow=["30/1", "33/1"])
    assert {r["giving"] for r in S.spec_scan(docs, known, [denied], days).collect()} == {"33/1"}


def test_containment_equals_brute_force(spark):
    texts_ = ["The quick  brown fox jumps", "quick brown fox", "a QUICK brown fox; over", "xx yy", "", None, "ab", "日本語の文", "fox jumps over the lazy dog " * 50]
    needles = ["quick brown fox", "brown fox", "fox jumps over", "yy", "x", "本語の", "", None, "the lazy dog fox", "quick  brown", "dog fox jumps over the"]
    t = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    n = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    got, blocks = ({tuple(r) for r in S.containment_join(t, "doc_id", "text", n, "item_id", "text", limit=c).collect()} for c in (10_000, 8))
    want = {(i, j) for i, a in enumerate(texts_) for j, b in enumerate(needles) if a and b and b.lower() in a.lower()}
    assert got == want == blocks
    assert S.containment_join(t.limit(0), "doc_id", "text", n, "item_id", "text").count() == 0


def test_no_text_meets_every_needle(spark, tmp_path):
    for name, col in (("t", "doc_id"), ("n", "item_id")):
        spark.range(9).select(F.col("id").alias(col), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text")).write.parquet(f"file://{tmp_path}/{name}")
    t, n = spark.read.parquet(f"file://{tmp_path}/t"), spark.read.parquet(f"file://{tmp_path}/n")
    plan = S.containment_join(t, "doc_id", "text", n, "item_id", "text")._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    large = S.containment_join(t, "doc_id", "text", n, "item_id", "text", limit=4)._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in large and "Cartesian" not in large and ("HashJoin" in large or "SortMergeJoin" in large)


def test_enrich_fans_out_and_merge_is_idempotent(spark, frames):
    nodes, _, _ = frames
    new = spark.createDataFrame([("30/1", "20 (x)"), ("30/1", "99/9")], "res_id2_doc_giving_cite string, res_id2_unlet_recv string")
    e = G.enrich_edges(new, nodes)
    assert e.columns == CITATION and e.count() == 3
    assert G.enrich_edges(new, nodes, section="A").where("res_id2_doc_receiv_cite IS NOT NULL").count() == 1
    assert e.where("cited_res IS NULL").count() == 3 and G.enrich_edges(new, nodes, as_coded=True).where("cited_res = ''").count() == 3
    keys = ["res_id2_doc_giving_cite", "res_id2_unlet_recv"]
    once = G.merge_edges(e.limit(0), e, keys)
    assert once.count() == 3 and G.merge_edges(once, G.enrich_edges(new, nodes, as_coded=True), keys).count() == 3


def test_degrees_drop_null_keys_and_check_matches_null_keys(spark):
    e = spark.createDataFrame([("a", "t"), ("a", None), (None, "t"), ("a", "t")], "k string, t string")
    assert [tuple(r) for r in G.in_degrees(e, ["k", "t"]).collect()] == [("a", "t", 2)]
    n = spark.createDataFrame([("a", "t"), (None, "u")], "k string, t string")
    assert tuple(G.check_edges(e, n, "k", "k", "t", "t").first()) == (4, 2)


def test_split_modes(spark):
    df = spark.createDataFrame([(f"r{k}", f"{1950 + k}-01-01") for k in range(10)] + [("r3", "2000-01-01")], "id string, d string").withColumn("d", F.to_date("d"))
    good = {r["id"]: r["split"] for r in T.chronological_split(df.where("d < '2000-01-01'"), "id", "d").collect()}
    assert [sum(v == s for v in good.values()) for s in ("train", "val", "test")] == [8, 1, 1] and good["r9"] == "test"
    bad = T.chronological_split(df.where("d < '2000-01-01'"), "id", "d", as_coded=True).collect()
    assert sorted((r["id"], r["split"]) for r in bad) == [("r8", "train"), ("r9", "test"), ("r9", "train"), ("r9", "val")]
    assert T.chronological_split(df, "id", "d").count() == 10
    assert T.chronological_split(df.limit(0), "id", "d").count() == 0


def test_answers_keep_duplicates_in_order(spark):
    e = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", None), (None, "z")], "k string, v string")
    assert [tuple(r) for r in T.answers(e, ["k"], F.col("v")).collect()] == [("k", "a, b, b")]
    o = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("k", "c", None)], "k string, v string, o int")
    assert [r["answer"] for r in T.answers(o, ["k"], F.col("v"), [F.col("o")]).collect()] == ["c, b, a, b"]
    assert T.answers(e.limit(0), ["k"], F.col("v")).count() == 0


def test_sections_have_answers_of_their_own(spark):
    """Of two lettered sections one cites: the other cites nothing, and symbols keep their letters."""
    nodes = spark.createDataFrame([("9/1 a", "9/1", "text a"), ("9/1 b", "9/1", "text b"), (" 9/2", "9/2", "text"), ("9/3", "9/3", None), (None, "9/4", "x")], "res_id2 string, res_id2_unlet string, content string").withColumn("symbol", F.lit("clash"))
    edges = [("9/1 a", "9/1", "text a", "3 May 1954", "8/2 b "), ("9/1 a", "9/1", "text a", "3 May 1954", "8/1"), ("9/1 a", "9/1", "text a", "2 May 1954", "8/9"), ("9/1 a", "9/1", "text a", "3 May 1954", "8/1"), ("9/2", "9/2", "text", None, None)]
    e = spark.createDataFrame(edges, "res_id2_doc_giving_cite string, res_id2_unlet_giv string, content_giv string, date_p_giv string, res_id2_doc_receiv_cite string").withColumn("answer", F.lit("clash"))
    got = {tuple(r) for r in T.qa_rows(nodes, e).collect()}
    assert got == {("A/RES/9/1A", "9/1", "text a", "A/RES/8/9, A/RES/8/1, A/RES/8/1, A/RES/8/2B"), ("A/RES/9/1B", "9/1", "text b", "None")}
    assert {r["symbol"] for r in T.qa_rows(nodes, e, as_coded=True).collect()} == {"A/RES/9/1A"}


def test_positions_of_ties_and_nulls(spark):
    from citeloom.operators.prefix import with_position

    rows = [(k, None if k % 3 == 0 else k % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, day int").withColumn("__x", F.lit("clash"))
    got = [r["id"] for r in with_position(df, [F.col("day").asc_nulls_last(), F.col("id").asc()], partitions=7).orderBy("pos").collect()]
    assert got == [k for k, d in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    assert [r["pos"] for r in with_position(df, [F.col("id").asc()]).select("pos").orderBy("pos").collect()] == list(range(200))
    assert with_position(df.limit(0), [F.col("id").asc()]).count() == 0


def test_convention_lines(spark):
    rows = ["C1 - Alpha Convention, 1948 (No. 87)", "C2 - Beta - Gamma", "C3 - Delta, 1950, revised, 1999", "  ", " C4 - Eps "]
    got = {r["code"]: (r["title"], r["year"], r["number"]) for r in parse_lines(spark.createDataFrame([(x,) for x in rows], "value string")).collect()}
    assert got["C1"][1:] == ("1948", "87") and got["C2"] == ("Beta - Gamma", None, None) and got["C3"][1] == "1950" and got["C4"][0] == "Eps"
    with pytest.raises(Exception, match="no delimiter"):
        parse_lines(spark.createDataFrame([("none",)], "value string")).collect()
    with pytest.raises(ValueError):
        parse_lines(spark.createDataFrame([("A - x",), ("B - x",)], "value string"))
