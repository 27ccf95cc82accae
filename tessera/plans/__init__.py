"""Dimensions, level tables and grids: what is known of an array before any data is read."""
