"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is the least node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step keeps the components and shrinks their depth,
    so the rounds grow with the logarithm of the nodes. All links of a hub are grouped by partial minima, never collected. Rows
    with a null end are dropped, loops and repeated edges change nothing, an empty table gives no rows. An end is reached when a
    round changes no edge; otherwise an error is raised after max_rounds.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = materialize(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(least, "u")
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def signature(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    last = signature(e)
    for _ in range(max_rounds):
        e = materialize(small_star(large_star(e)), "edges")
        now = signature(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components didn't settle")
    labels = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
