"""Guarded plans."""
