"""Relational operators on pixels, colours, runs and grid candidates."""
