"""Layered analytics on PySpark."""
