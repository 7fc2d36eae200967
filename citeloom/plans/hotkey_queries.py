"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import plain_identifier
from citeloom.operators.hotkeys import counts_by_field, hot_keys, per_key
from citeloom.runtime import table

FIELDS = ["res_id2_doc_receiv_cite", "res_id2_unlet_recv"]


def _fields() -> dict:
    return {f: plain_identifier(f) for f in FIELDS}


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return hot_keys(table(spark, root, "ga_citations_1946_2019"), _fields()).select("key_field", "key_value")


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    return counts_by_field(table(spark, root, "ga_citations_1946_2019"), _fields())


def p6_per_cited(spark: SparkSession, root: str) -> DataFrame:
    """Per cited resolution: rows, rows added later, first and last giving date text, length of the longest cited form."""
    c = table(spark, root, "ga_citations_1946_2019")
    return per_key(c, {"cited": plain_identifier("res_id2_doc_receiv_cite")}, {
        "n_rows": F.count(F.lit(1)), "n_added": F.count_if(F.col("cited_res") == ""), "n_dated": F.count("date_p_giv"),
        "first_giving": F.min("res_id2_doc_giving_cite"), "last_giving": F.max("res_id2_doc_giving_cite"),
        "longest_form": F.max(F.length("cited_res")), "letters": F.sum(F.length("cited_res")),
    })


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts, "p6_per_cited": p6_per_cited}

_PLAIN = r"regexp_replace(regexp_replace(lower({c}), '[\s\p{{Z}}\x0B\x{{85}}\x1C-\x1F]+', '', 'g'), '^a/res/', '')"
_BOTH = " UNION ALL ".join(f"SELECT '{c}' AS key_field, {_PLAIN.format(c=c)} AS key_value FROM ga_citations_1946_2019" for c in FIELDS)

SQL = {
    "p6_found": f"SELECT key_field, key_value FROM ({_BOTH}) WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.03 * (SELECT count(*) FROM ga_citations_1946_2019)",
    "p6_counts": f"SELECT key_field, key_value, count(*) AS n_rows FROM ({_BOTH}) GROUP BY ALL",
    "p6_per_cited": f"""SELECT {_PLAIN.format(c=FIELDS[0])} AS cited, count(*) AS n_rows, count(*) FILTER (cited_res = '') AS n_added,
        count(date_p_giv) AS n_dated, min(res_id2_doc_giving_cite) AS first_giving, max(res_id2_doc_giving_cite) AS last_giving,
        CAST(max(length(cited_res)) AS INTEGER) AS longest_form, CAST(sum(length(cited_res)) AS BIGINT) AS letters
        FROM ga_citations_1946_2019 GROUP BY 1""",
}
