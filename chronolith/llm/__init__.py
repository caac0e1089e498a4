"""Training-data operators: sanitising, scoring, deduplication, tokenizing, search and sharding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
