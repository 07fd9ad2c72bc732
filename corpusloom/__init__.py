"""A PySpark engine for document corpora."""
