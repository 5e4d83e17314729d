"""Functions on text: built-in expressions in `text`, state machines in `scan`."""
