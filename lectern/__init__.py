"""Corpus, retrieval and study analytics as PySpark jobs over many tenants."""
