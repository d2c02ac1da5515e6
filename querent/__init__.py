"""Ranked retrieval over Spark DataFrames: lexical, sparse and dense search, fusion, reranking and evaluation."""

__version__ = "0.1.0"
