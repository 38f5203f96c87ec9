"""Training-data operators: deduplication, quality, toxicity, packing, sharding, token output.

Nothing outside this subpackage imports it; its queries are listed in
``evalgrid.llm.catalog``.
"""
