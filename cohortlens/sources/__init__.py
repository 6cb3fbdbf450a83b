"""Readers: rule documents, fact files, notes, recordings and tables."""
