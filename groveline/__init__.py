"""Groveline: Spark-first document retrieval, text analytics and corpus preparation."""
