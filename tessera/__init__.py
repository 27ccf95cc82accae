"""Tessera: sparse coordinate arrays and training-data operators as Spark jobs."""
