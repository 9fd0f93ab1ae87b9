"""Genome stop-codon analytics on Spark DataFrames."""
