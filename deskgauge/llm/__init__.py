"""Operators for training-data pipelines; nothing outside this folder and ``corpus_pipeline.py`` imports them."""
