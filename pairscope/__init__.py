"""Pairwise-interaction analytics expressed as Spark DataFrame plans."""
