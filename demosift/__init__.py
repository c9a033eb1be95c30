"""Choosing and evaluating demonstration examples over parallel text corpora, on Spark."""
