"""The citation graph: degrees, checks of edges against nodes, new edges written out in full and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.relational import same_columns, union_by_name
from citeloom.sources.schemas import CITATION, GIVING, RECEIVING


def in_degrees(edges: DataFrame, keys: list[str], count: str = "citation_count") -> DataFrame:
    """Edges per receiving node; edges with a null in any key are left out. Map-side partial counts, so hubs cost no more."""
    return edges.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def by_count(keys: list[str], count: str = "citation_count") -> list[Column]:
    """Most cited first, ties by the keys."""
    return [F.desc(count), *[F.asc(k) for k in keys]]


def check_edges(edges: DataFrame, nodes: DataFrame, edge_key: str, node_key: str, edge_text: str, node_text: str) -> DataFrame:
    """(n_joined, n_equal): pairs of edge and node of equal key, null keys matching each other, and those of equal text."""
    e = edges.select(F.col(edge_key).alias("__ek"), F.col(edge_text).alias("__et"))
    n = nodes.select(F.col(node_key).alias("__nk"), F.col(node_text).alias("__nt"))
    j = e.join(n, F.col("__ek").eqNullSafe(F.col("__nk")))
    return j.agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(F.coalesce(F.col("__et") == F.col("__nt"), F.lit(False))).alias("n_equal"))


def enrich_edges(new_edges: DataFrame, nodes: DataFrame, section: str | None = None, as_coded: bool = False) -> DataFrame:
    """New edges (res_id2_doc_giving_cite, res_id2_unlet_recv) with both ends written out, in the columns of the edge table.

    The giving end is looked up by res_id2, the receiving by res_id2_unlet; as that names all lettered sections, an edge gives one
    row per section, or only that of `section`. An end that no node has stays null. cited_res, cited_res_conv and n_outg_cit are
    null, '' with as_coded.
    """
    giving = nodes.select(F.col("res_id2").alias("__g"), *[F.col(c[:-4]).alias(c) for c in GIVING])
    receiving = nodes.select(F.col("res_id2_unlet").alias("__r"), F.col("res_letter").alias("__letter"), F.col("res_id2").alias("res_id2_doc_receiv_cite"), *[F.col(c[:-5]).alias(c) for c in RECEIVING])
    if section is not None:
        receiving = receiving.where(F.lower("__letter").eqNullSafe(section.lower()))
    e = new_edges.select("res_id2_doc_giving_cite", "res_id2_unlet_recv").distinct()
    e = e.join(giving, F.col("res_id2_doc_giving_cite") == F.col("__g"), "left").join(receiving, F.col("res_id2_unlet_recv") == F.col("__r"), "left")
    blank = F.lit("" if as_coded else None).cast("string")
    return e.withColumns({c: blank for c in ("cited_res", "cited_res_conv", "n_outg_cit")}).select(*CITATION)


def merge_edges(edges: DataFrame, added: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges and added ones of the same columns, whole-row duplicates once. With keys, an added row whose keys (null equal to
    null) stand among the edges is left out, so merging twice changes nothing."""
    same_columns(edges, added)
    if keys:
        old = edges.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        cond = [added[k].eqNullSafe(old[f"__{k}"]) for k in keys]
        added = added.join(old, cond, "left_anti")
    return union_by_name(edges, added.select(*edges.columns)).distinct()
