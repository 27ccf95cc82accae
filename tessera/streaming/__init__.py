"""Appending slabs of coordinates from streams."""
