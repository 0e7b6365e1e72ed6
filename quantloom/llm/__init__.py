"""Training-data operators: sharding, packing, deduplication, filters and classifiers.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
