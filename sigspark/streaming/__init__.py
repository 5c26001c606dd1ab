"""Incremental frequencies over files of calls that keep arriving."""
