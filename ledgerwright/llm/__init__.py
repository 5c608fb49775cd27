"""Training-data operators: token counts, BPE, packing, line dedup, quality
classifier, archive fixity, n-gram join, PII, exact search, quality rules.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
