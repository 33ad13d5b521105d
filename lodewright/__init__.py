"""Counting and searching over large text corpora, as Spark plans."""
