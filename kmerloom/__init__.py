"""Sequence classification and training-data operators on Spark."""
