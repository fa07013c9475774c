"""Operators for training-data pipelines over large text, page and vector corpora."""
