"""Queries over the citation graph: degrees, checks, scans for missing edges, enrichment and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import parse_date
from citeloom.operators import graph as G
from citeloom.operators import relational as R
from citeloom.operators.conventions import convention_citations, parse_lines
from citeloom.operators.textscan import TitleSpec, givers, spec_scan, title_scan, wrong_title_audit
from citeloom.runtime import table
from citeloom.sources.schemas import CITATION, GIVING, RECEIVING

TOP_KEYS = ["filename_recv", "topic_recv", "res_id2_doc_receiv_cite", "res_id3_recv"]
RANK_KEYS = ["topic_recv", "res_id2_doc_receiv_cite", "res_id2_unlet_recv", "res_id3_recv"]
SPECS = [
    TitleSpec("937 (iii)", ["customary bail provision", "bail provision of"], avoid=[r"bail provision and (?:of )?the \w+"]),
    TitleSpec("915 (xxv)", [r"barter accords?", r"market\s+access(?:es)?"], avoid=[r"customs (?:union|yard)"], match="regex"),
    TitleSpec("951 (xxix)", ["agenda item"], deny=["5 (ii)"], also_cite=["974 (xv)"]),
    TitleSpec("55/955", ["coal seam"], accept=False),
]


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ga_citations_1946_2019")


def _nodes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ga_resolutions_1946_2019")


def top_cited_30(spark, root):
    return R.top(G.in_degrees(_edges(spark, root), TOP_KEYS), G.by_count(TOP_KEYS), 30)


def rank_31_50(spark, root):
    return R.last_of_first(G.in_degrees(_edges(spark, root), RANK_KEYS), G.by_count(RANK_KEYS), 50, 20)


def in_degrees(spark, root):
    return G.in_degrees(_edges(spark, root), ["res_id2_unlet_recv"])


def sanity_join(spark, root):
    return G.check_edges(_edges(spark, root), _nodes(spark, root), "res_id2_doc_giving_cite", "res_id2", "content_giv", "content")


def distinct_edges(spark, root):
    return _edges(spark, root).select("res_id2_doc_giving_cite", "res_id2_unlet_recv").distinct()


def against_time(spark, root):
    """Edges whose giving end isn't strictly later than the receiving."""
    giv, recv = parse_date("date_p_giv"), parse_date("date_p_recv")
    return _edges(spark, root).where(giv <= recv).select("res_id2_doc_giving_cite", "res_id2_doc_receiv_cite", giv.alias("day_giv"), recv.alias("day_recv"))


def reference_dates(spark, root):
    return R.lookup_one(_nodes(spark, root), "res_id2_unlet", "date_p", "ord")


def _documents(spark, root):
    return givers(_edges(spark, root).withColumn("day_giv", parse_date("date_p_giv")))


def _known(spark, root):
    return _edges(spark, root).select(F.col("res_id2_doc_giving_cite").alias("giving"), F.col("res_id2_unlet_recv").alias("res_id"))


def _days(spark, root):
    return R.lookup_one(_nodes(spark, root), "res_id2_unlet", "date_p", "ord").select(F.col("res_id2_unlet").alias("res_id"), parse_date("date_p").alias("day"))


def title_scan_top(spark, root):
    """Missing citations of the 200 most cited resolutions, by all of their titles, in one job."""
    top = R.top(G.in_degrees(_edges(spark, root), ["res_id2_unlet_recv"]), G.by_count(["res_id2_unlet_recv"]), 200).select(F.col("res_id2_unlet_recv").alias("res_id"))
    titles = _nodes(spark, root).where("title IS NOT NULL").select(F.col("res_id2_unlet").alias("res_id"), "title").distinct()
    return title_scan(_documents(spark, root), _known(spark, root), titles.join(top, "res_id").join(_days(spark, root), "res_id"))


def title_scan_cited(spark, root):
    """Missing citations of all resolutions that are cited at all, in one job."""
    cited = G.in_degrees(_edges(spark, root), ["res_id2_unlet_recv"]).select(F.col("res_id2_unlet_recv").alias("res_id"))
    titles = _nodes(spark, root).where("title IS NOT NULL").select(F.col("res_id2_unlet").alias("res_id"), "title").distinct()
    return title_scan(_documents(spark, root), _known(spark, root), titles.join(cited, "res_id").join(_days(spark, root), "res_id"))


def title_scan_variants(spark, root):
    return spec_scan(_documents(spark, root), _known(spark, root), SPECS, _days(spark, root))


def wrong_titles(spark, root):
    citing = _known(spark, root).where("res_id = '937 (iii)'")
    return wrong_title_audit(_documents(spark, root), citing, "the", "bail provision")


def _added(spark, root):
    return _edges(spark, root).where("cited_res = ''").select("res_id2_doc_giving_cite", "res_id2_unlet_recv")


def enrich_edges(spark, root):
    return G.enrich_edges(_added(spark, root), _nodes(spark, root), as_coded=True)


def merge_edges(spark, root):
    e = _edges(spark, root).select(*CITATION)
    return G.merge_edges(e, G.enrich_edges(_added(spark, root), _nodes(spark, root)), ["res_id2_doc_giving_cite", "res_id2_unlet_recv"])


def convention_lines(spark, root):
    c = table(spark, root, "conventions")
    line = F.concat(F.lit("  "), "code", F.lit(" - "), "title", F.coalesce(F.concat(F.lit(", "), "year"), F.lit("")), F.coalesce(F.concat(F.lit(" (No. "), "number", F.lit(")")), F.lit("")))
    blank = spark.createDataFrame([("  ",), ("",)], "value string")
    return parse_lines(c.select(line.alias("value")).unionByName(blank), unique_titles=False)


def convention_hits(spark, root):
    return convention_citations(_nodes(spark, root), table(spark, root, "conventions"))


def passages_in_documents(spark, root):
    """Held-out passages that stand verbatim, but for case, in a document."""
    from citeloom.operators.textscan import containment_join

    return containment_join(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")


QUERIES = {f.__name__: f for f in (top_cited_30, rank_31_50, in_degrees, sanity_join, distinct_edges, against_time, reference_dates, title_scan_top, title_scan_cited, title_scan_variants, wrong_titles, enrich_edges, merge_edges, convention_lines, convention_hits, passages_in_documents)}

_SP = r"[\s\p{Z}\x0B\x{85}\x1C-\x1F]"


def _day(c: str) -> str:
    s = f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"
    return "CAST(coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in ("%Y-%m-%d", "%d %B %Y", "%Y/%m/%d")) + ") AS DATE)"


def _degrees(keys: list[str]) -> str:
    return f"SELECT {', '.join(keys)}, count(*) AS citation_count FROM ga_citations_1946_2019 WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY ALL"


_ORDER = lambda keys: "citation_count DESC, " + ", ".join(keys)
_DOCS = f"docs AS (SELECT res_id2_doc_giving_cite AS giving, min(content_giv) AS txt, min({_day('date_p_giv')}) AS day FROM ga_citations_1946_2019 GROUP BY 1)"
_DAYS = f"days AS (SELECT res_id2_unlet AS res_id, {_day('arg_min(date_p, ord)')} AS day FROM (SELECT * FROM ga_resolutions_1946_2019 WHERE res_id2_unlet IS NOT NULL) GROUP BY 1)"
_KNOWN = "known AS (SELECT DISTINCT res_id2_doc_giving_cite AS giving, res_id2_unlet_recv AS res_id FROM ga_citations_1946_2019)"
_HAS = lambda t: f"coalesce(contains(lower(txt), '{t}'), false)"
_RX = lambda p: f"coalesce(regexp_matches(txt, '(?i){p}'), false)"
_HITS = " UNION ALL ".join(
    f"SELECT giving, day, '{s.res_id}' AS hit_of FROM docs WHERE ({' OR '.join((_RX(v) if s.match == 'regex' else _HAS(v)) for v in s.variants)})"
    + "".join(f" AND NOT {_RX(a)}" for a in s.avoid) + (f" AND giving NOT IN ({', '.join(repr(d) for d in s.deny)})" if s.deny else "") for s in SPECS)
_TARGETS = ", ".join(f"('{s.res_id}', '{t}')" for s in SPECS for t in [s.res_id, *s.also_cite])


def _wide(blank: str) -> str:
    cols = {"res_id2_doc_giving_cite": "e.g", "res_id2_unlet_recv": "e.r", "res_id2_doc_receiv_cite": "rn.res_id2"} | {c: f"gn.{c[:-4]}" for c in GIVING} | {c: f"rn.{c[:-5]}" for c in RECEIVING} | {c: blank for c in ("cited_res", "cited_res_conv", "n_outg_cit")}
    return f"SELECT {', '.join(f'{cols[c]} AS {c}' for c in CITATION)} FROM (SELECT DISTINCT res_id2_doc_giving_cite AS g, res_id2_unlet_recv AS r FROM ga_citations_1946_2019 WHERE cited_res = '') e LEFT JOIN ga_resolutions_1946_2019 gn ON e.g = gn.res_id2 LEFT JOIN ga_resolutions_1946_2019 rn ON e.r = rn.res_id2_unlet"


_PAIR = "res_id2_doc_giving_cite, res_id2_unlet_recv"
_CONV_LINE = "code || ' - ' || title || coalesce(', ' || year, '') || coalesce(' (No. ' || number || ')', '')"
SQL = {
    "top_cited_30": f"{_degrees(TOP_KEYS)} ORDER BY {_ORDER(TOP_KEYS)} LIMIT 30",
    "rank_31_50": f"WITH d AS ({_degrees(RANK_KEYS)}), r AS (SELECT *, CAST(row_number() OVER (ORDER BY {_ORDER(RANK_KEYS)}) AS INTEGER) AS rank FROM d), f AS (SELECT * FROM r WHERE rank <= 50) SELECT * FROM f WHERE rank > (SELECT count(*) FROM f) - 20",
    "in_degrees": _degrees(["res_id2_unlet_recv"]),
    "sanity_join": "SELECT count(*) AS n_joined, CAST(coalesce(sum(CASE WHEN e.content_giv = n.content THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_equal FROM ga_citations_1946_2019 e JOIN ga_resolutions_1946_2019 n ON e.res_id2_doc_giving_cite IS NOT DISTINCT FROM n.res_id2",
    "distinct_edges": f"SELECT DISTINCT {_PAIR} FROM ga_citations_1946_2019",
    "against_time": f"SELECT res_id2_doc_giving_cite, res_id2_doc_receiv_cite, {_day('date_p_giv')} AS day_giv, {_day('date_p_recv')} AS day_recv FROM ga_citations_1946_2019 WHERE {_day('date_p_giv')} <= {_day('date_p_recv')}",
    "reference_dates": "SELECT res_id2_unlet, date_p FROM (SELECT *, row_number() OVER (PARTITION BY res_id2_unlet ORDER BY ord) AS k FROM ga_resolutions_1946_2019 WHERE res_id2_unlet IS NOT NULL) WHERE k = 1",
    "title_scan_top": f"WITH {_DOCS}, {_KNOWN}, days AS (SELECT res_id2_unlet AS res_id, {_day('date_p')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY res_id2_unlet ORDER BY ord) AS k FROM ga_resolutions_1946_2019) WHERE k = 1), top AS ({_degrees(['res_id2_unlet_recv'])} ORDER BY citation_count DESC, res_id2_unlet_recv LIMIT 200), titles AS (SELECT DISTINCT n.res_id2_unlet AS res_id, n.title, days.day FROM ga_resolutions_1946_2019 n JOIN top ON n.res_id2_unlet = top.res_id2_unlet_recv JOIN days ON days.res_id = n.res_id2_unlet WHERE n.title IS NOT NULL) SELECT DISTINCT d.giving, t.res_id FROM docs d JOIN titles t ON contains(lower(d.txt), lower(t.title)) AND d.day > t.day AND d.giving <> t.res_id WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.giving = d.giving AND k.res_id = t.res_id)",
    "title_scan_variants": f"WITH {_DOCS}, {_KNOWN}, days AS (SELECT res_id2_unlet AS res_id, {_day('date_p')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY res_id2_unlet ORDER BY ord) AS k FROM ga_resolutions_1946_2019) WHERE k = 1), hits AS ({_HITS}), targets(hit_of, res_id) AS (VALUES {_TARGETS}) SELECT h.giving, t.res_id, h.hit_of FROM (SELECT DISTINCT h.giving, h.hit_of FROM hits h JOIN days ON days.res_id = h.hit_of WHERE h.day > days.day AND h.giving <> h.hit_of AND NOT EXISTS (SELECT 1 FROM known k WHERE k.giving = h.giving AND k.res_id = h.hit_of)) h JOIN targets t ON t.hit_of = h.hit_of",
    "wrong_titles": f"WITH {_DOCS}, {_KNOWN} SELECT giving FROM docs WHERE giving IN (SELECT giving FROM known WHERE res_id = '937 (iii)') AND {_HAS('the')} AND NOT {_HAS('bail provision')}",
    "enrich_edges": _wide("''"),
    "merge_edges": f"SELECT DISTINCT {', '.join(CITATION)} FROM (SELECT {', '.join(CITATION)} FROM ga_citations_1946_2019 UNION ALL SELECT * FROM ({_wide('CAST(NULL AS VARCHAR)')}) w WHERE NOT EXISTS (SELECT 1 FROM ga_citations_1946_2019 c WHERE c.res_id2_doc_giving_cite IS NOT DISTINCT FROM w.res_id2_doc_giving_cite AND c.res_id2_unlet_recv IS NOT DISTINCT FROM w.res_id2_unlet_recv))",
    "convention_lines": f"WITH l AS (SELECT code, {_CONV_LINE.replace('code || ', '', 1).replace(chr(39) + ' - ' + chr(39) + ' || ', '', 1)} AS t FROM conventions) SELECT code, t AS title, nullif(regexp_extract(t, ',\\s*(\\d{{4}})', 1), '') AS year, nullif(regexp_extract(t, '\\(No\\.\\s*([^)]+)\\)', 1), '') AS number FROM l",
    "convention_hits": "SELECT DISTINCT r.res_id2, c.title AS conv_prot_rec FROM ga_resolutions_1946_2019 r JOIN conventions c ON contains(lower(r.content), lower(c.title))",
    "passages_in_documents": "SELECT DISTINCT d.doc_id, i.item_id FROM documents d JOIN eval_items i ON contains(lower(d.text), lower(i.text))",
}
SQL["title_scan_cited"] = SQL["title_scan_top"].replace(" ORDER BY citation_count DESC, res_id2_unlet_recv LIMIT 200", "")
