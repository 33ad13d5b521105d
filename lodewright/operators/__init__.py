"""Analyses of a corpus: DataFrame in, DataFrame out."""
