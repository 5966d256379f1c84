"""Operators for preparing language-model training data, each as Spark jobs."""
