"""Records from lines such as 'CODE - Title, 1948 (No. 87)', and their citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import extract_or_null, strip
from citeloom.operators.textscan import containment_join


def parse_lines(lines: DataFrame, value: str = "value", unique_titles: bool = True) -> DataFrame:
    """(code, title, year, number) of each line that isn't blank. year: four digits behind the first comma that has them; number:
    what stands in the first '(No. ...)'; both texts, null where missing. A line without ' - ' raises, and so do two equal
    titles unless unique_titles=False."""
    line = strip(value)
    rows = lines.select(line.alias("line")).where("line IS NOT NULL AND line != ''")
    parts = F.split("line", " - ", 2)
    rows = rows.select(F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("no delimiter: "), F.col("line"))).cast("array<string>")).alias("p"))
    out = rows.select(strip(F.col("p")[0]).alias("code"), strip(F.col("p")[1]).alias("title"))
    # How a line writes its year and number.
    out = out.select("code", "title", extract_or_null("title", r",\s*(\d{4})").alias("year"), extract_or_null("title", r"\(No\.\s*([^)]+)\)").alias("number"))
    if unique_titles:
        twice = out.groupBy("title").count().where("count > 1").head()
        if twice is not None:
            raise ValueError(f"title stands twice: {twice['title']}")
    return out


def convention_citations(nodes: DataFrame, conventions: DataFrame, text: str = "content") -> DataFrame:
    """(res_id2, conv_prot_rec): titles that occur in a resolution's text, ignoring case."""
    hits = containment_join(nodes, "res_id2", text, conventions, "title", "title")
    return hits.select("res_id2", F.col("title").alias("conv_prot_rec"))
