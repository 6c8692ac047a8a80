"""Operators of a training-data pipeline over tables of documents.

Nothing outside this subpackage imports it. Each operator has a module of its own; ``queries``
holds the thin queries that apply them to whole tables.
"""
