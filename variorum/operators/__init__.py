"""Relational operators over documents, units, tables and matches."""
