"""Operators that prepare training data for language models. Nothing outside this subpackage imports it."""

#: The modules with QUERIES and SQL.
NAMES = ["similar_vectors", "subjects", "scan_repair", "near_duplicates", "cross_split", "residue", "leakage", "mixing", "sentences"]
