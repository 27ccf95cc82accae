"""Readers and writers of coordinate tables."""
