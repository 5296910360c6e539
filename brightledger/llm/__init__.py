"""Training-data operators: deduplication, scoring, search, mixing, tokenising.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it can be imported.
"""
