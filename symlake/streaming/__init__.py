"""Streams of files: extraction has no state, so it runs as it stands on new files only."""

from .incremental import analyse_stream, count_stream

__all__ = ["analyse_stream", "count_stream"]
