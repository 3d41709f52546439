"""Retrieval, graph search, evaluation and corpus preparation as Spark DataFrame plans."""
