"""Lodestone: evidence analytics on Spark."""
