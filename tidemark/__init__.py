"""Tidemark: Spark-first scoring, drift and selective-prediction analytics over tables of vectors and logits."""
