"""Batch text retrieval, its evaluation and corpus preparation as Spark jobs."""
