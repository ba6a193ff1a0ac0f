"""Event-time windows."""
