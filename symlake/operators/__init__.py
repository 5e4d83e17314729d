"""Operators: extraction, relations, web assets, merging, summaries."""
