"""The index, the search over it, settings and the commands."""
