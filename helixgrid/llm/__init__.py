"""Training-data operators: token counts, near duplicates, packing, scoring and search over corpora.

Nothing outside this subpackage imports it; `queries.py` lists its queries for the entry module.
"""
