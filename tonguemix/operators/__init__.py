"""Relational operators: indexing, tokenizing, selection, matching, models and detection."""
