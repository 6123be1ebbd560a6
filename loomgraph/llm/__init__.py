"""Training-data operators: packing, decontamination, quality, near-duplicates, sharding, WARC, token counts, toxicity, URL rules.

Nothing outside this subpackage imports it; the queries that apply the operators to the test tables are in ``queries``.
"""
