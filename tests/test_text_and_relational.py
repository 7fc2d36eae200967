import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import relational as R
from citeloom.operators.components import connected_components
from citeloom.operators.hotkeys import hot_keys, per_key
from citeloom.operators.prefix import running_sum


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("r")).first()["r"]


def test_strip_and_identifiers(spark):
    assert one(spark, T.strip, " \t x y  \x1f") == "x y"
    assert one(spark, T.plain_identifier, " A/RES/ 2200 A (XXI)\t") == "2200a(xxi)"
    assert one(spark, T.plain_identifier, None) is None
    assert one(spark, T.canonical_symbol, "55/2 a") == "A/RES/55/2A"
    assert one(spark, T.csv_null, "NA") is None and one(spark, T.csv_null, "na ") == "na "


def test_contains(spark):
    assert one(spark, lambda c: T.contains_regex(c, "état"), "L'ÉTAT") is True
    assert one(spark, lambda c: T.contains_regex(c, "x"), None) is False
    assert one(spark, lambda c: T.contains_literal(c, F.lit("a.c")), "xA.Cx") is True
    assert one(spark, lambda c: T.contains_literal(c, F.lit("a.c")), "abc") is False
    with pytest.raises(Exception, match="null text"):
        one(spark, lambda c: T.contains_regex(c, "x", strict=True), None)
    assert one(spark, lambda c: T.not_equal_keep_null(c, "a"), None) is True


def test_dates(spark):
    for s in ("1951-10-07", " 7 October 1951", "1951/10/07"):
        assert one(spark, T.parse_date, s) == datetime.date(1951, 10, 7)
    assert one(spark, T.parse_date, "someday") is None
    with pytest.raises(Exception, match="no date"):
        one(spark, lambda c: T.parse_date(c, strict=True), "someday")


def test_url_join(spark):
    j = lambda c: T.url_join("https://h.example", c)
    assert [one(spark, j, x) for x in ("http://a/b", "/x", "//c/d", "y", None)] == ["http://a/b", "https://h.example/x", "https://c/d", "https://h.example/y", None]


def test_distinct_on_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "n"), (None, 4, "m")], "k string, o int, v string")
    last = {r["k"]: r["v"] for r in R.distinct_on(df, ["k"], [F.col("o")], "last").collect()}
    first = {r["k"]: r["v"] for r in R.distinct_on(df, ["k"], [F.col("o")]).collect()}
    assert last == {"a": None, None: "m"} and first == {"a": "x", None: "n"}


def test_rank_slice(spark):
    for n, want in ((60, (31, 50)), (50, (31, 50)), (35, (16, 35)), (10, (1, 10)), (0, None)):
        df = spark.range(n).select(F.col("id"))
        got = [r["rank"] for r in R.last_of_first(df, [F.desc("id")], 50, 20).collect()]
        assert (min(got), max(got)) == want if want else got == []


def test_anti_semi_and_lookup(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, o int")
    b = spark.createDataFrame([("x", 9), (None, 9)], "k string, o int")  # clashing column
    assert sorted(r["o"] for r in R.anti(a, b, {"k": "k"}).collect()) == [2, 3]
    assert sorted(r["o"] for r in R.anti(a, b, {"k": "k"}, nulls_match=True).collect()) == [2]
    assert [r["o"] for r in R.semi(a, b, {"k": "k"}).collect()] == [1]
    with pytest.raises(KeyError):
        R.lookup_strict(a, "k", "o", "o", "missing")
    assert R.count_values(a, "k").first()[0] == 3
    with pytest.raises(ValueError):
        R.same_columns(a, b.drop("o"))


def test_per_key_and_hot_keys(spark):
    df = spark.createDataFrame([("A/RES/1",)] * 40 + [(" 1 ",)] * 20 + [(None,)] * 30 + [(str(k),) for k in range(100, 110)], "k string")
    hot = hot_keys(df, {"k": T.plain_identifier("k")}, 0.3).collect()
    assert [(r["key_value"], r["n_rows"]) for r in hot] == [("1", 60)]
    got = per_key(df, {"k": F.col("k")}, {"n": F.count(F.lit(1))})
    assert got.where("k IS NULL").first()["n"] == 30
    assert per_key(df, {"k": F.col("k")}, {"n": F.count(F.lit(1))}, keep_null_keys=False).where("k IS NULL").count() == 0
    with pytest.raises(ValueError):
        per_key(df, {"k": F.col("k")}, {"n": F.collect_list("k")})
    assert hot_keys(df.limit(0), {"k": F.col("k")}).count() == 0


def test_running_sum_of_one_large_group(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("v"))
    got = {r["id"]: r["s"] for r in running_sum(df, ["g"], [F.col("id")], F.col("v"), (F.col("id") / 100).cast("int"), "s", 10).collect()}
    acc = 0
    for k in range(1000):
        assert got[k] == acc
        acc += k if k % 5 else 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 102), (200, 200), (7, 3), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[k] for k in range(31)} == {0} and got[102] == 100 and got[200] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
