"""Readers, writers and the tables derived from the given data."""
