"""Readers and writers of corpora, lexicons and counts."""
