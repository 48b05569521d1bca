"""Operators for training-data pipelines: extraction, filtering, deduplication,
tokenisation and packing of documents.  Nothing else in the library imports
this subpackage."""
