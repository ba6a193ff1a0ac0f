"""Marlstone: document, case and graph analytics as PySpark DataFrame plans."""
