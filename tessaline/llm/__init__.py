"""Training-data operators: classifiers, dedup, packing, scans, tokenising, search.

Nothing outside this subpackage imports it; `tessaline.llm.registry` lists its
queries for the entry module.
"""
