"""Corpus, retrieval and knowledge-maintenance operators as DataFrame transformations."""

__version__ = "0.1.0"
