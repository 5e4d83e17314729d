"""Whole analyses: a project as tables, and a session that answers commands from them."""
