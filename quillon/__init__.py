"""Quillon: document search and corpus processing as PySpark DataFrame programs."""
