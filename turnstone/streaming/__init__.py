"""Refreshing an index as log files arrive."""
