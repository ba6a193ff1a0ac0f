"""Readers of documents and blocks."""
