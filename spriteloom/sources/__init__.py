"""Readers and writers: images, palettes, presets, batch export."""
