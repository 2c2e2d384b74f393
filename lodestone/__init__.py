"""Spark-native maximum inner product search over sparse vectors, with the evaluation and selection tools around it."""
