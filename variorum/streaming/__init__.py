"""Streams of document revisions (an extension)."""
