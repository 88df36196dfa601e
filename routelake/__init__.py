"""Prompt and conversation curation, and batch model routing, on Spark DataFrames."""
