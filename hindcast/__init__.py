"""Leakage-safe evidence retrieval and forecast evaluation on Spark DataFrames."""
