"""Relational, search, state and graph operators."""
