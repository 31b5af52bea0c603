"""Training-data operators: dedup, scoring, search, quality, tokenising and mixing.

Nothing outside this package (and corpus_pipeline.py) imports it.  The package
init stays empty on purpose: Python workers import single operator modules.
"""
