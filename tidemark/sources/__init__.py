"""Readers, writers and canonical views over the given tables."""
