"""Readers and writers of corpora, indexes, features, models and results."""
