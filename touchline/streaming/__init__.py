"""Incremental load of landed documents."""
