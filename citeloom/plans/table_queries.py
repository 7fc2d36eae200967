"""Queries over single tables: deduplication, splits, training rows, texts, vectors, pages, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import canonical_symbol, extract_or_null, not_equal_keep_null, parse_date, strip, url_join
from citeloom.operators import html as H
from citeloom.operators import relational as R
from citeloom.operators import trainset as T
from citeloom.operators import vectors as V
from citeloom.runtime import shared_dir, table
from citeloom.sources.sinks import json_line
from citeloom.streaming import incremental as I

HOST = "https://instruments.example"
SYSTEM = T.CHAT_SYSTEM


def _t(name: str):
    return lambda spark, root: table(spark, root, name)


_res, _sub, _ins, _cit, _doc = _t("ga_resolutions_1946_2019"), _t("ga_resolutions_subjects"), _t("ohchr_instruments_detailed"), _t("ga_citations_1946_2019"), _t("documents")


def dedupe_keep_first(spark, root):
    return R.distinct_on(_res(spark, root).select("res_id2", "ord", "title", "date_p"), ["res_id2"], [F.col("ord")], "first")


def dedupe_keep_last(spark, root):
    return R.distinct_on(_res(spark, root).select("res_id2", "ord", "title", "date_p"), ["res_id2"], [F.col("ord")], "last")


def union_instruments(spark, root):
    """Two lists of titles, the second winning where both have one; a null title is one title."""
    core = table(spark, root, "conventions").select("title", F.lit(0).alias("src"), F.col("code").alias("pos"))
    full = _ins(spark, root).select("title", F.col("adopted_by").alias("adopted_text"), "url", F.lit(1).alias("src"), F.lpad(F.col("ord").cast("string"), 12, "0").alias("pos"))
    return R.distinct_on(R.union_by_name(core, full), ["title"], [F.col("src"), F.col("pos")], "last").select("title", "adopted_text", "url", "src")


def overlap_counts(spark, root):
    return R.overlap(_sub(spark, root), _res(spark, root), "title")


def semi_titles(spark, root):
    return R.semi(_sub(spark, root).select("res_id", "title"), _res(spark, root), {"res_id": "res_id2"})


def uncited_anti(spark, root):
    return T.uncited(_res(spark, root).select("ord", "res_id2"), _cit(spark, root), "res_id2", "res_id2_doc_giving_cite")


def nonnull_symbols(spark, root):
    return I.purge_failed(_sub(spark, root), "symbol")


def not_in_session(spark, root):
    """Rows of other types than regular; nulls count as different."""
    return _res(spark, root).where(not_equal_keep_null("session_es", "1") & not_equal_keep_null("session_sp", "1")).select("ord", "session_es", "session_sp")


def resume_batch(spark, root):
    return I.todo(_res(spark, root).select("ord", F.col("res_id2").alias("res_id")), _sub(spark, root), "res_id", "ord", 5_000, "symbol IS NOT NULL")


def value_counts(spark, root):
    return R.count_values(_res(spark, root), "location")


def head_rows(spark, root):
    return R.top(_res(spark, root).select("ord", "res_id2"), [F.col("ord")], 5)


def tail_rows(spark, root):
    return R.top(_res(spark, root).select("ord", "res_id2"), [F.desc("ord")], 5)


def rows_by_year(spark, root):
    return _res(spark, root).groupBy(F.year(parse_date("date_p")).alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))


def chrono_split(spark, root):
    return T.chronological_split(_res(spark, root).withColumn("d", parse_date("date_p")), "res_id2_unlet", "d")


def chrono_split_as_coded(spark, root):
    return T.chronological_split(_res(spark, root).withColumn("d", parse_date("date_p")), "res_id2_unlet", "d", as_coded=True)


def ordered_answers(spark, root):
    c = _cit(spark, root).withColumns({"day": parse_date("date_p_giv"), "receiving": strip("res_id2_doc_receiv_cite")})
    return T.answers(c, ["res_id2_doc_giving_cite", "res_id2_unlet_giv", "content_giv"], canonical_symbol("receiving"), [F.col("day"), F.col("receiving")])


def qa_rows(spark, root):
    return T.qa_rows(_res(spark, root), _cit(spark, root))


def chat_messages(spark, root):
    q = T.qa_rows(_res(spark, root), _cit(spark, root))
    return q.select("symbol", "res_id", json_line(T.chat(SYSTEM, F.col("question_text"), F.col("answer"))).alias("line"))


def training_lines(spark, root):
    t = T.training_lines(_res(spark, root).withColumn("d", parse_date("date_p")), _cit(spark, root), "d")
    return t.select("split", "symbol", "res_id", json_line(F.col("sample")).alias("line"))


def canonical_symbols(spark, root):
    return _res(spark, root).select("ord", canonical_symbol(strip("res_id2")).alias("symbol"))


def extract_years(spark, root):
    return _ins(spark, root).select("ord", extract_or_null("adopted_by", r",\s*\d+ \w+ (\d{4})").alias("year"), extract_or_null("adopted_by", r"decision\s+([^,]+)$").alias("decision"))


def sentence_stats(spark, root):
    s = V.sentences(F.col("text"))
    return _doc(spark, root).where("text IS NOT NULL").select("doc_id", F.size(s).alias("n_sentences"), F.array_max(F.transform(s, lambda x: F.length(x))).alias("longest"))


def url_absolute(spark, root):
    return _ins(spark, root).select("ord", url_join(HOST, "pdf_url").alias("pdf"), F.coalesce(~F.startswith("pdf_url", F.lit("http")), F.lit(False)).alias("was_relative"))


def real_pages(spark, root):
    return _ins(spark, root).where(H.is_real_page(F.col("content"))).select("ord")


def _escape(c):
    c = F.coalesce(c, F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_cards(spark, root):
    """Cards written as pages and read back."""
    page = F.concat(F.lit("<html><body><div><a class='card big' href='"), _escape(F.col("url")), F.lit("'><h3 class='card__heading'><span>"), _escape(F.col("title")), F.lit("</span></h3><p class='adopted'>"), _escape(F.col("adopted_by")), F.lit("</p></a><a class='card'>no address</a></div></body></html>"))
    return H.cards(_ins(spark, root).select("ord", page.alias("html")), "html", ["ord"], "a.card", "h3.card__heading span", "p.adopted")


def html_fields(spark, root):
    """Labelled rows of tables written as pages and read back."""
    row = lambda label, *cells: F.concat(F.lit(f"<tr><td> {label} </td>"), *[F.concat(F.lit("<td>"), _escape(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    page = F.concat(F.lit("<table><tbody>"), row("Title", F.col("title")), row("SYMBOL", F.col("symbol")), row("Subject(s)", F.col("subject"), F.lit("")), row("All downloads", F.col("downloads").cast("string"), F.lit("n/a"), F.lit("3")), F.lit("</tbody></table>"))
    s = _sub(spark, root).select("url", page.alias("html")).withColumn("rows", H.table_rows(F.col("html")))
    return s.select("url", H.field_of(F.col("rows"), "symbol").alias("symbol"), H.field_of(F.col("rows"), "Subject(s)").alias("subject"), H.field_of(F.col("rows"), "Session / Year").alias("session_year"), H.digits_of(F.col("rows"), "downloads").alias("downloads"))


def html_accordion(spark, root):
    """A table of records under each year written as a page and read back."""
    page = F.concat(F.lit("<dl><dt>"), F.col("year"), F.lit("</dt><dd><table><tr><td><a href='/r/"), F.col("code"), F.lit("'>"), F.col("code"), F.lit("</a></td><td>"), _escape(F.col("title")), F.lit("</td></tr><tr><td>only one</td></tr><tr><td></td><td>a</td><td>b</td></tr></table></dd><dt>1900</dt></dl>"))
    return H.accordion_rows(table(spark, root, "conventions").where("year IS NOT NULL").select(page.alias("html")), "html", [])


def vector_norms(spark, root):
    v = table(spark, root, "doc_embeddings").where("doc_embedding IS NOT NULL")
    return v.select("vec_id", F.size("doc_embedding").alias("dim"), F.round(V.norm(F.col("doc_embedding")), 5).alias("norm"))


def vectors_normalized(spark, root):
    v = table(spark, root, "embeddings").withColumn("u", V.l2_normalize(F.col("embedding")))
    return v.select("vec_id", F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 5).alias("first"))


def weighted_centroid(spark, root):
    c = V.weighted_mean(table(spark, root, "embeddings"), "label", "embedding", F.col("vec_id") % 7 + 1, normalize=False)
    return c.select("label", F.posexplode("vec").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def topk_inner_product(spark, root):
    e = table(spark, root, "embeddings")
    return V.top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, skip_self=True).withColumn("score", F.round("score", 5))


def verify_self_top1(spark, root):
    e = table(spark, root, "embeddings")
    return V.self_retrieval(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding")


def vector_summary(spark, root):
    s = V.summary(table(spark, root, "embeddings"), "embedding")
    return s.withColumns({"norm_min": F.round("norm_min", 5), "norm_max": F.round("norm_max", 5)})


def events_by_hour(spark, root):
    return I.windowed_counts(table(spark, root, "events"), "ts", "event_type")


def stream_events(spark, root):
    """Events taken once, through a stream over the table's folder; counts per type."""
    import uuid

    at = f"{shared_dir(spark)}/citeloom/stream-{uuid.uuid4().hex}"
    schema = table(spark, root, "events").schema
    I.stream_new(spark, f"{root}/events.parquet*", schema, "event_id", f"{at}/out", f"{at}/state", lambda b: b)
    return spark.read.schema(schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


QUERIES = {f.__name__: f for f in (dedupe_keep_first, dedupe_keep_last, union_instruments, overlap_counts, semi_titles, uncited_anti, nonnull_symbols, not_in_session, resume_batch, value_counts, head_rows, tail_rows, rows_by_year, chrono_split, chrono_split_as_coded, ordered_answers, qa_rows, chat_messages, training_lines, canonical_symbols, extract_years, sentence_stats, url_absolute, real_pages, html_cards, html_fields, html_accordion, vector_norms, vectors_normalized, weighted_centroid, topk_inner_product, verify_self_top1, vector_summary, events_by_hour, stream_events)}

_SP = r"[\s\p{Z}\x0B\x{85}\x1C-\x1F]"
_strip = lambda c: f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"
_day = lambda c: "CAST(coalesce(" + ", ".join(f"try_strptime({_strip(c)}, '{f}')" for f in ("%Y-%m-%d", "%d %B %Y", "%Y/%m/%d")) + ") AS DATE)"
_symbol = lambda c: f"'A/RES/' || upper(replace({c}, ' ', ''))"
_KEEP = lambda way: f"SELECT res_id2, ord, title, date_p FROM (SELECT *, row_number() OVER (PARTITION BY res_id2 ORDER BY ord {way}) AS k FROM ga_resolutions_1946_2019) WHERE k = 1"
_SPLIT = lambda rows: f"WITH r AS ({rows}), p AS (SELECT *, row_number() OVER (ORDER BY day ASC NULLS LAST, id) - 1 AS pos, count(*) OVER () AS n FROM r)"
_IDS = f"SELECT DISTINCT res_id2_unlet AS id, {_day('date_p')} AS day FROM ga_resolutions_1946_2019 WHERE res_id2_unlet IS NOT NULL"
_GIVEN = f"""SELECT {_symbol(_strip('res_id2_doc_giving_cite'))} AS symbol, {_strip('res_id2_unlet_giv')} AS res_id, content_giv AS question_text,
    {_strip('res_id2_doc_receiv_cite')} AS r, {_strip('res_id2_doc_giving_cite')} AS g, {_day('date_p_giv')} AS d FROM ga_citations_1946_2019 WHERE res_id2_doc_receiv_cite IS NOT NULL"""
_QA = f"""SELECT symbol, res_id, question_text, string_agg({_symbol('r')}, ', ' ORDER BY d ASC NULLS FIRST, g, r) AS answer FROM ({_GIVEN}) given
    WHERE symbol IS NOT NULL AND res_id IS NOT NULL AND question_text IS NOT NULL GROUP BY 1, 2, 3
    UNION ALL SELECT DISTINCT {_symbol(_strip('n.res_id2'))}, {_strip('n.res_id2_unlet')}, n.content, 'None' FROM ga_resolutions_1946_2019 n
    LEFT JOIN (SELECT DISTINCT {_strip('res_id2_doc_giving_cite')} AS g FROM ga_citations_1946_2019) c ON c.g = {_strip('n.res_id2')}
    WHERE c.g IS NULL AND n.content IS NOT NULL AND n.res_id2_unlet IS NOT NULL AND n.res_id2 IS NOT NULL"""
_SENT = f"list_filter(list_transform(string_split(text, '. '), lambda s: {_strip('s')}), lambda s: s <> '')"
_BLOCK = " OR ".join(f"contains(lower(content), '{p}')" for p in H.BLOCK_PHRASES)
_clean = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_E = "CAST(embedding AS DOUBLE[])"
SQL = {
    "dedupe_keep_first": _KEEP("ASC"),
    "dedupe_keep_last": _KEEP("DESC"),
    "union_instruments": "WITH u AS (SELECT title, NULL AS adopted_text, NULL AS url, 0 AS src, code AS pos FROM conventions UNION ALL SELECT title, adopted_by, url, 1, lpad(CAST(ord AS VARCHAR), 12, '0') FROM ohchr_instruments_detailed) SELECT title, adopted_text, url, src FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY src DESC, pos DESC) AS k FROM u) WHERE k = 1",
    "overlap_counts": " UNION ALL ".join(f"SELECT '{side}' AS side, count(*) AS n_rows, count(*) FILTER (title IN (SELECT title FROM {b} WHERE title IS NOT NULL)) AS n_in_other FROM {a}" for side, a, b in (("left", "ga_resolutions_subjects", "ga_resolutions_1946_2019"), ("right", "ga_resolutions_1946_2019", "ga_resolutions_subjects"))),
    "semi_titles": "SELECT res_id, title FROM ga_resolutions_subjects WHERE res_id IN (SELECT res_id2 FROM ga_resolutions_1946_2019)",
    "uncited_anti": f"SELECT ord, res_id2 FROM ga_resolutions_1946_2019 r WHERE NOT EXISTS (SELECT 1 FROM ga_citations_1946_2019 c WHERE {_strip('c.res_id2_doc_giving_cite')} = {_strip('r.res_id2')})",
    "nonnull_symbols": "SELECT * FROM ga_resolutions_subjects WHERE symbol IS NOT NULL",
    "not_in_session": "SELECT ord, session_es, session_sp FROM ga_resolutions_1946_2019 WHERE session_es IS DISTINCT FROM '1' AND session_sp IS DISTINCT FROM '1'",
    "resume_batch": "SELECT ord, res_id2 AS res_id FROM ga_resolutions_1946_2019 r WHERE NOT EXISTS (SELECT 1 FROM ga_resolutions_subjects s WHERE s.symbol IS NOT NULL AND s.res_id = r.res_id2) ORDER BY ord LIMIT 5000",
    "value_counts": "SELECT count(DISTINCT location) + CAST(max(CAST(location IS NULL AS INTEGER)) AS BIGINT) AS n_values FROM ga_resolutions_1946_2019",
    "head_rows": "SELECT ord, res_id2 FROM ga_resolutions_1946_2019 ORDER BY ord LIMIT 5",
    "tail_rows": "SELECT ord, res_id2 FROM ga_resolutions_1946_2019 ORDER BY ord DESC LIMIT 5",
    "rows_by_year": f"SELECT CAST(year({_day('date_p')}) AS INTEGER) AS year, count(*) AS n_rows FROM ga_resolutions_1946_2019 GROUP BY 1",
    "chrono_split": _SPLIT(f"SELECT id, min(day) AS day FROM ({_IDS}) GROUP BY id") + " SELECT id, day, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM p",
    "chrono_split_as_coded": _SPLIT(_IDS) + " SELECT id, day, 'train' AS split FROM p WHERE pos >= floor(n * 0.8) UNION ALL SELECT id, day, 'val' FROM p WHERE pos >= floor(n * 0.9) UNION ALL SELECT id, day, 'test' FROM p WHERE pos >= floor(n * 0.9)",
    "ordered_answers": f"SELECT res_id2_doc_giving_cite, res_id2_unlet_giv, content_giv, string_agg({_symbol(_strip('res_id2_doc_receiv_cite'))}, ', ' ORDER BY {_day('date_p_giv')} ASC NULLS FIRST, {_strip('res_id2_doc_receiv_cite')}) AS answer FROM ga_citations_1946_2019 WHERE res_id2_doc_giving_cite IS NOT NULL AND res_id2_unlet_giv IS NOT NULL AND content_giv IS NOT NULL AND res_id2_doc_receiv_cite IS NOT NULL GROUP BY 1, 2, 3",
    "qa_rows": _QA,
    "chat_messages": f"SELECT symbol, res_id, CAST(json_object('messages', json_array(json_object('role', 'system', 'content', '{SYSTEM}'), json_object('role', 'user', 'content', question_text), json_object('role', 'assistant', 'content', answer))) AS VARCHAR) AS line FROM ({_QA})",
    "training_lines": _SPLIT(f"SELECT id, min(day) AS day FROM (SELECT {_strip('res_id2_unlet')} AS id, {_day('date_p')} AS day FROM ga_resolutions_1946_2019 WHERE res_id2_unlet IS NOT NULL) GROUP BY id") + f", s AS (SELECT id, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM p) SELECT s.split, q.symbol, q.res_id, CAST(json_object('messages', json_array(json_object('role', 'system', 'content', '{SYSTEM}'), json_object('role', 'user', 'content', question_text), json_object('role', 'assistant', 'content', answer))) AS VARCHAR) AS line FROM ({_QA}) q JOIN s ON s.id = q.res_id",
    "canonical_symbols": f"SELECT ord, {_symbol(_strip('res_id2'))} AS symbol FROM ga_resolutions_1946_2019",
    "extract_years": r"SELECT ord, nullif(regexp_extract(adopted_by, ',\s*\d+ \w+ (\d{4})', 1), '') AS year, nullif(regexp_extract(adopted_by, 'decision\s+([^,]+)$', 1), '') AS decision FROM ohchr_instruments_detailed",
    "sentence_stats": f"SELECT doc_id, CAST(CASE WHEN len({_SENT}) = 0 THEN 1 ELSE len({_SENT}) END AS INTEGER) AS n_sentences, CAST(CASE WHEN len({_SENT}) = 0 THEN length(text) ELSE list_max(list_transform({_SENT}, lambda s: length(s))) END AS INTEGER) AS longest FROM documents WHERE text IS NOT NULL",
    "url_absolute": f"SELECT ord, CASE WHEN regexp_matches({_strip('pdf_url')}, '(?i)^https?://') THEN {_strip('pdf_url')} WHEN starts_with({_strip('pdf_url')}, '//') THEN 'https:' || {_strip('pdf_url')} WHEN starts_with({_strip('pdf_url')}, '/') THEN '{HOST}' || {_strip('pdf_url')} ELSE '{HOST}/' || {_strip('pdf_url')} END AS pdf, coalesce(NOT starts_with(pdf_url, 'http'), false) AS was_relative FROM ohchr_instruments_detailed",
    "real_pages": f"SELECT ord FROM ohchr_instruments_detailed WHERE NOT coalesce({_BLOCK}, false) AND length({_strip('content')}) > 100",
    "html_cards": f"SELECT ord, {_clean('title')} AS title, {_clean('coalesce(adopted_by, {0})'.format(chr(39) * 2))} AS adopted_text, url FROM ohchr_instruments_detailed",
    "html_fields": f"SELECT url, nullif({_clean('coalesce(symbol, {0})'.format(chr(39) * 2))}, '') AS symbol, nullif({_clean('coalesce(subject, {0})'.format(chr(39) * 2))}, '') AS subject, CAST(NULL AS VARCHAR) AS session_year, coalesce(downloads, 0) + 3 AS downloads FROM ga_resolutions_subjects",
    "html_accordion": f"SELECT year, code, '' AS adoption, {_clean('title')} AS title, '/r/' || code AS url FROM conventions WHERE year IS NOT NULL",
    "vector_norms": "SELECT vec_id, CAST(len(doc_embedding) AS INTEGER) AS dim, round(sqrt(list_inner_product(CAST(doc_embedding AS DOUBLE[]), CAST(doc_embedding AS DOUBLE[]))), 5) AS norm FROM doc_embeddings WHERE doc_embedding IS NOT NULL",
    "vectors_normalized": f"WITH n AS (SELECT vec_id, {_E} AS e, sqrt(list_inner_product({_E}, {_E})) AS n FROM embeddings) SELECT vec_id, CAST(CASE WHEN n = 0 THEN 0 ELSE 1 END AS DOUBLE) AS norm, round(e[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS first FROM n",
    "weighted_centroid": f"WITH u AS (SELECT label, CAST(vec_id % 7 + 1 AS DOUBLE) AS w, unnest({_E}) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, round(sum(w * x) / sum(w), 6) AS x FROM u GROUP BY label, i",
    "topk_inner_product": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, neighbour_id, round(score, 5) AS score FROM r WHERE rank <= 5",
    "verify_self_top1": "WITH s AS (SELECT a.vec_id AS id, max(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS best, max(CASE WHEN a.vec_id = b.vec_id THEN list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END) AS own FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0 GROUP BY 1) SELECT id, abs(best - own) < 1e-5 AS ok FROM s",
    "vector_summary": f"SELECT count(embedding) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS dim_min, CAST(max(len(embedding)) AS INTEGER) AS dim_max, round(min(sqrt(list_inner_product({_E}, {_E}))), 5) AS norm_min, round(max(sqrt(list_inner_product({_E}, {_E}))), 5) AS norm_max FROM embeddings",
    "events_by_hour": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_events": "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1",
}
