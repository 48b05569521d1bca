"""Typed, schema-governed analytics on PySpark."""
