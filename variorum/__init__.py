"""Comparison of document revisions on Spark."""
