"""citeloom: citation-graph, text-mining and vector-indexing operators on PySpark DataFrames."""

__version__ = "0.1.0"
