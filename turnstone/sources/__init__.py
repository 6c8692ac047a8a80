"""Readers of conversation logs."""
