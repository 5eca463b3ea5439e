"""Training-data operators: quality, licences, mixing, dedup, WARC, sharding, BPE.

Nothing outside this package imports it; ``llm.queries`` registers the queries.
"""
