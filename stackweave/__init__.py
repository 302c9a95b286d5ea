"""Spark-first engine for crash-report similarity, duplicate retrieval and ranking evaluation."""
