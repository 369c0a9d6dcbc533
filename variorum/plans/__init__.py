"""Comparison pipelines, options and the catalog of queries."""
