"""Spark jobs that curate noisy posting feeds and training corpora."""
