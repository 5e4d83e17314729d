"""Extraction of symbols and side lists from source text, one recogniser per language family."""

from .run import analyse, extract

__all__ = ["analyse", "extract"]
