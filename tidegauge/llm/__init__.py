"""Training-data operators: mixing, classifiers, near-duplicates, archives, token files.

Nothing outside this subpackage imports it; its queries are in :mod:`tidegauge.llm.queries`.
"""
