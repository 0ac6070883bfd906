"""Spark retrieval and context-budget analytics."""
