"""Incremental arrival of image files."""
