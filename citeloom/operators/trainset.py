"""Chat-style training samples from the citation graph, split by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import canonical_symbol, parse_date, strip
from citeloom.operators.prefix import with_position


#: Fixed value: the system's turn of every training sample.
CHAT_SYSTEM = "You are a strict information extraction system. Extract only United Nations general assembly resolution codes from the input. Do not explain, do not add commentary, return only results."


def chronological_split(df: DataFrame, id_col: str, day: str, parts: tuple[float, float] = (0.8, 0.9), as_coded: bool = False) -> DataFrame:
    """(id, day, split): train, val and test in order of date, undated ones last, ties by id.

    One row for each id (its first date); as_coded: one for each pair of id and date, with train the rows behind the first cut and
    val and test both those behind the second, as a slice from the wrong end gives, a row once for each split that holds it.
    Positions come from ranges of the order, so no task sorts the whole table or all rows of one day or without one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(day).alias("day")).where("id IS NOT NULL").distinct()
    if not as_coded:
        rows = rows.groupBy("id").agg(F.min("day").alias("day"))
    at = with_position(rows, [F.col("day").asc_nulls_last(), F.col("id").asc()])
    total = at.agg(F.count(F.lit(1)).alias("n")).scalar()
    a, b = (F.floor(total * F.lit(p)) for p in parts)
    if as_coded:
        hit = F.array_compact(F.array(F.when(F.col("pos") >= a, "train"), F.when(F.col("pos") >= b, "val"), F.when(F.col("pos") >= b, "test")))
        return at.select("id", "day", F.explode(hit).alias("split"))
    return at.select("id", "day", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test").alias("split"))


def uncited(nodes: DataFrame, edges: DataFrame, node_key: str, edge_key: str) -> DataFrame:
    """Nodes that give no citation, ids stripped on both sides; nodes with a null id are kept."""
    e = edges.select(strip(edge_key).alias("__e")).where("__e IS NOT NULL").distinct()
    return nodes.join(e, strip(nodes[node_key]) == F.col("__e"), "left_anti")


def answers(edges: DataFrame, keys: list[str], value: Column, order: list[Column] | None = None, sep: str = ", ") -> DataFrame:
    """(keys, answer): the values of each key in `order` (nulls first, ties by value; by value alone if no order is given),
    duplicates kept, null values left out; keys with a null or without a value are dropped.

    Repeated values are counted before they meet, so the state of a key holds its different values only; its answer is one text
    and must be as long as all of them.
    """
    rank = order or []
    rows = edges.dropna(subset=keys).select(*keys, value.alias("__v"), *[c.alias(f"__o{k}") for k, c in enumerate(rank)]).where("__v IS NOT NULL")
    names = [f"__o{k}" for k in range(len(rank))] + ["__v"]
    counted = rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    all_ = F.sort_array(F.collect_list(F.struct(*names, F.col("__n").cast("int").alias("__n"))))
    said = F.flatten(F.transform("__all", lambda x: F.array_repeat(x["__v"], x["__n"])))
    return counted.groupBy(*keys).agg(all_.alias("__all")).select(*keys, F.array_join(said, sep).alias("answer"))


def qa_rows(nodes: DataFrame, edges: DataFrame, as_coded: bool = False) -> DataFrame:
    """(symbol, res_id, question_text, answer): per giving document, that is per lettered symbol, unlettered id and text, the
    symbols it cites by date of giving, giving and receiving id; duplicates are kept. A section that gives no citation at all
    has 'None', whatever its sister sections cite (as_coded: is lost, as its keys are null). Unresolved targets are left out; a
    document of unresolved targets alone has no row, for neither is true of it that it cites nothing nor known what."""
    cited = edges.where("res_id2_doc_receiv_cite IS NOT NULL").withColumn("__r", strip("res_id2_doc_receiv_cite"))
    cited = cited.select(canonical_symbol(strip("res_id2_doc_giving_cite")).alias("symbol"), strip("res_id2_unlet_giv").alias("res_id"), F.col("content_giv").alias("question_text"),
                         parse_date("date_p_giv").alias("day"), strip("res_id2_doc_giving_cite").alias("giving"), F.col("__r").alias("receiving"), canonical_symbol("__r").alias("cites"))
    out = answers(cited, ["symbol", "res_id", "question_text"], F.col("cites"), [F.col("day"), F.col("giving"), F.col("receiving")])
    if as_coded:
        return out
    none = uncited(nodes, edges, "res_id2", "res_id2_doc_giving_cite").where("res_id2 IS NOT NULL AND res_id2_unlet IS NOT NULL AND content IS NOT NULL")
    none = none.select(canonical_symbol(strip("res_id2")).alias("symbol"), strip("res_id2_unlet").alias("res_id"), F.col("content").alias("question_text"), F.lit("None").alias("answer")).distinct()
    return out.unionByName(none)


def chat(system: str | Column, user: Column, assistant: Column) -> Column:
    """struct(messages): a conversation of three turns; nulls become empty texts."""
    sys = F.lit(system) if isinstance(system, str) else system
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    return F.struct(F.array(turn("system", sys), turn("user", user), turn("assistant", assistant)).alias("messages"))


def training_lines(nodes: DataFrame, edges: DataFrame, day: str, system: str = CHAT_SYSTEM, as_coded: bool = False) -> DataFrame:
    """(split, symbol, res_id, sample): chat samples of all documents, each in the split of its unlettered id; ids are stripped on
    both sides. With as_coded the overlapping splits of slices from the wrong end, and no documents without citations."""
    split = chronological_split(nodes.withColumn("__id", strip("res_id2_unlet")), "__id", day, as_coded=as_coded).select(F.col("id").alias("res_id"), "split").distinct()
    rows = qa_rows(nodes, edges, as_coded).join(split, "res_id")
    return rows.select("split", "symbol", "res_id", chat(system, F.col("question_text"), F.col("answer")).alias("sample"))


def in_order(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples sorted by their group's keys, for a sink whose files shall follow that order."""
    return samples.orderBy(*keys)
