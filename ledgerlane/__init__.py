"""Spark-native analytics for financial question answering: programs, verification, retrieval, graphs and corpus statistics."""
