"""Corvane: panel time series, dynamic graphs and graph embeddings on Spark."""
