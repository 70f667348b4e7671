"""Spark jobs that build and evaluate conversation corpora."""
