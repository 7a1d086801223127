"""Training-data pipeline operators (language id, archives, near-duplicates, packing, quality, mixing, counts, toxicity, search).

Nothing outside this subpackage imports it; `registry.py` lists its queries.
"""
