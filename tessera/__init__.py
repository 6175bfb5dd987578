"""Tessera: evidence-governed screening analytics on Spark."""
