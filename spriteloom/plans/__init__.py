"""Whole-image pipelines."""
