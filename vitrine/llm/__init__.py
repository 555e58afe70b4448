"""Training-data operators: deduplication, scoring, packing, tokenizing, scans.

Nothing outside this package (and ``corpus_pipeline.py``) imports it; the
queries of its operators are listed in :mod:`vitrine.llm.queries`.
"""
