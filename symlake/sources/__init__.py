"""Sources: trees of files as tables, what of them is read, and the gates before parsing."""
