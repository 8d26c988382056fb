"""Operators for text corpora and records that feed language models."""
