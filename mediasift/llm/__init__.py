"""Operators of a training-data pipeline: near-duplicates, filters, mixing, packing, archives.

Nothing outside this package, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
