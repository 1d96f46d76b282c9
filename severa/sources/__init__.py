"""Readers, writers and generators of graph instances."""
