"""Queries over sources, sinks, pages and the vector index: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from citeloom.functions.text import CSV_NULLS, parse_date
from citeloom.operators import html as H
from citeloom.operators import relational as R
from citeloom.operators import trainset as T
from citeloom.operators import vectors as V
from citeloom.operators.conventions import parse_lines
from citeloom.plans.graph_queries import SQL as GRAPH_SQL
from citeloom.plans.table_queries import HOST, _SENT, _clean, _escape
from citeloom.plans.table_queries import SQL as TABLE_SQL
from citeloom.runtime import shared_dir, table
from citeloom.sources import readers as RD
from citeloom.sources import sinks as SK


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/citeloom/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark, root):
    """Texts with quotes and line breaks through CSV, the usual spellings of a missing value as null."""
    at = _folder(spark, "csv")
    columns = ["ord", "res_id2", "title", "content"]
    SK.write_csv(table(spark, root, "ga_resolutions_1946_2019"), at, columns)
    return RD.read_csv(spark, at, columns).withColumn("ord", F.col("ord").cast("bigint"))


def lines_round_trip(spark, root):
    """Lines of text files, parsed."""
    at = _folder(spark, "lines")
    c = table(spark, root, "conventions")
    c.select(F.concat("code", F.lit(" - "), "title", F.coalesce(F.concat(F.lit(", "), "year"), F.lit("")), F.coalesce(F.concat(F.lit(" (No. "), "number", F.lit(")")), F.lit("")))).write.text(at)
    return parse_lines(RD.read_lines(spark, at), unique_titles=False)


def jsonl_round_trip(spark, root):
    """Chat samples as JSON lines, a folder for each split, sorted by symbol."""
    at = _folder(spark, "jsonl")
    t = T.training_lines(table(spark, root, "ga_resolutions_1946_2019").withColumn("d", parse_date("date_p")), table(spark, root, "ga_citations_1946_2019"), "d")
    SK.write_jsonl(T.in_order(t, ["split", "symbol", "res_id"]), F.col("sample"), at, split="split")
    return spark.read.text(at).select("split", F.col("value").alias("line"))


def staged_append(spark, root):
    """A table appended to and then replaced by a plan that reads it."""
    at = _folder(spark, "staged")
    c = table(spark, root, "conventions").select("code", "title")
    SK.append(c.where("code < 'C3'"), at)
    SK.append(c.where("NOT code < 'C3'"), at)
    both = spark.read.parquet(at)
    SK.staged_overwrite(both.select("code", F.upper("title").alias("title")), at)
    return spark.read.parquet(at)


def year_pages(spark, root):
    """Years of a range, and the addresses of a list's pages."""
    years = RD.numbers(spark, 2000, 2019).select(F.col("year").cast("int").alias("n"), F.concat(F.lit(f"{HOST}/y/"), F.col("year").cast("string")).alias("url"))
    return years.unionByName(RD.page_urls(spark, f"{HOST}/list", 4).select(F.col("page").alias("n"), "url"))


def fetched_pages(spark, root):
    """Pages through the source "pages"; those of odd codes fail and are rows too."""

    def get(url: str) -> str:
        if int(url.rsplit("/", 1)[1]) % 2:
            raise OSError("gone")
        return f"<p>{url}</p>"

    RD.register_pages(spark, get)
    urls = [f"{HOST}/{k}" for k in range(20)]
    got = spark.read.format("pages").option("urls", "\n".join(urls)).option("partitions", "4").load()
    return got.select("url", "ok", "error", H.css_text(F.col("html"), "p").alias("text"))


def html_details(spark, root):
    """Detail pages written by the query and read back; the text of a page whose title is odd in length is a guard's."""
    guard = F.length("title") % 2 == 1
    page = F.concat(F.lit("<html><head><title>x</title></head><body><div class='content-hero'><p>"), _escape(F.col("adopted_by")), F.lit("</p></div><div class='main-content'><script>no()</script>"),
                    F.when(guard, F.lit("Checking your browser")).otherwise(_escape(F.regexp_replace("title", "[^A-Za-z ]", ""))), F.lit("</div><div class='paragraph--type--file-version'><a class='pdf' href='"), _escape(F.coalesce("pdf_url", F.lit("/none"))), F.lit("'>PDF</a></div></body></html>"))
    return H.detail_rows(table(spark, root, "ohchr_instruments_detailed").select("ord", page.alias("html")), "html", ["ord"], HOST)


def html_pagination(spark, root):
    """A list of five pages followed by its next links."""
    pages = {f"/l?page={k}": f"<ul><li>{k}</li></ul>" + (f"<a class='next' href='/l?page={k + 1}'>next</a>" if k < 4 else "<a class='next disabled' href='/l?page=0'>next</a>") for k in range(5)}
    got = RD.literal(spark, list(H.collect_pages("/l?page=0", pages.__getitem__, "a.next")), "url string, html string")
    return got.select("url", H.visible_text(F.col("html")).alias("text"), H.css_attr(F.col("html"), "a.next", "href").alias("next"))


def zipped_rows(spark, root):
    c = table(spark, root, "conventions")
    return R.zip_rows(c.select("code"), c.select("title"), [F.col("code")], [F.desc("title")])


def sentence_index(spark, root):
    s = V.sentence_index(table(spark, root, "documents"), "doc_id", "text", V.letters_embedder)
    return s.select("doc_id", "sent_no", F.length("sentence").alias("n_chars"), F.round(F.col("vec")[4], 5).alias("e"))


def document_vectors(spark, root):
    v = V.document_vectors(table(spark, root, "documents"), "doc_id", "text", V.letters_embedder)
    return v.select("doc_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "i", F.round("x", 5).alias("x"))


def index_batches(spark, root):
    """An index that grows by batches of 25 documents until nothing is left; each row's number in it."""
    at = _folder(spark, "index")
    schema = StructType([StructField("code", StringType()), StructField("title", StringType()), StructField("pos", LongType())])
    while V.extend_index(table(spark, root, "conventions"), at, schema, "code", lambda todo: todo.select("code", "title"), "code", 25, "pos"):
        pass
    return RD.read_or_empty(spark, at, schema)


QUERIES = {f.__name__: f for f in (csv_round_trip, lines_round_trip, jsonl_round_trip, staged_append, year_pages, fetched_pages, html_details, html_pagination, zipped_rows, sentence_index, document_vectors, index_batches)}

_NULLS = ", ".join("'" + x.replace("'", "''") + "'" for x in CSV_NULLS)
_null = lambda c: f"CASE WHEN {c} IN ({_NULLS}) THEN NULL ELSE {c} END AS {c}"
_e = lambda c: _clean(f"coalesce({c}, '')")
_LETTERS = "regexp_replace(title, '[^A-Za-z ]', '', 'g')"
_OK = "length(title) % 2 = 0"
_PDF = "coalesce(pdf_url, '/none')"
_PARTS = f"p AS (SELECT doc_id, CASE WHEN len({_SENT}) = 0 THEN [text] ELSE {_SENT} END AS ss FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS k FROM p), c AS (SELECT doc_id, k, s, list_transform(range(97, 123), lambda x: CAST(length(lower(s)) - length(replace(lower(s), chr(CAST(x AS INTEGER)), '')) AS DOUBLE)) AS v FROM s), u AS (SELECT *, greatest(sqrt(list_inner_product(v, v)), CASE WHEN list_sum(v) = 0 THEN 1 ELSE 0 END) AS n FROM c)"
SQL = {
    "csv_round_trip": f"SELECT ord, {_null('res_id2')}, {_null('title')}, {_null('content')} FROM ga_resolutions_1946_2019",
    "lines_round_trip": GRAPH_SQL["convention_lines"],
    "jsonl_round_trip": f"SELECT split, line FROM ({TABLE_SQL['training_lines']}) t",
    "staged_append": "SELECT code, upper(title) AS title FROM conventions",
    "year_pages": f"SELECT CAST(range AS INTEGER) AS n, '{HOST}/y/' || range AS url FROM range(2000, 2020) UNION ALL SELECT CAST(range AS INTEGER), '{HOST}/list?page=' || range FROM range(4)",
    "fetched_pages": f"SELECT '{HOST}/' || range AS url, range % 2 = 0 AS ok, CASE WHEN range % 2 = 1 THEN 'OSError: gone' END AS error, CASE WHEN range % 2 = 0 THEN '{HOST}/' || range END AS text FROM range(20)",
    "html_details": f"SELECT ord, CASE WHEN {_OK} THEN nullif({_e('adopted_by')}, '') ELSE 'SECURITY_BLOCK' END AS adopted_by, CASE WHEN {_OK} THEN nullif({_clean(_LETTERS)}, '') END AS content, CASE WHEN {_OK} THEN CASE WHEN regexp_matches({_PDF}, '(?i)^https?://') THEN {_PDF} WHEN starts_with({_PDF}, '/') THEN '{HOST}' || {_PDF} ELSE '{HOST}/' || {_PDF} END END AS pdf_url, CASE WHEN {_OK} THEN 'OK' ELSE 'SECURITY_BLOCK' END AS status FROM ohchr_instruments_detailed",
    "html_pagination": "SELECT '/l?page=' || range AS url, range || CASE WHEN range < 5 THEN 'next' END AS text, '/l?page=' || CASE WHEN range < 4 THEN range + 1 ELSE 0 END AS next FROM range(5)",
    "zipped_rows": "SELECT a.code, b.title FROM (SELECT code, row_number() OVER (ORDER BY code) AS k FROM conventions) a JOIN (SELECT title, row_number() OVER (ORDER BY title DESC) AS k FROM conventions) b USING (k)",
    "sentence_index": f"WITH {_PARTS} SELECT doc_id, CAST(k AS INTEGER) AS sent_no, CAST(length(s) AS INTEGER) AS n_chars, round(v[5] / n, 5) AS e FROM u",
    "document_vectors": f"WITH {_PARTS}, x AS (SELECT doc_id, greatest(length(s), 1) AS w, n, unnest(v) AS e, unnest(range(26)) AS i FROM u), m AS (SELECT doc_id, i, sum(w * e / n) / sum(w) AS m FROM x GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(m * m)) AS l FROM m GROUP BY 1) SELECT doc_id, CAST(i AS INTEGER) AS i, round(m / CASE WHEN l = 0 THEN 1 ELSE l END, 5) AS x FROM m JOIN l USING (doc_id)",
    "index_batches": "SELECT code, title, row_number() OVER (ORDER BY code) - 1 AS pos FROM conventions",
}
