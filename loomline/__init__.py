"""Corpus analytics, lexical retrieval and short-answer extraction on Spark."""
