"""Incremental versions of yearly counts for tables that grow by new files."""
