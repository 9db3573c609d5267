"""Weighted de Bruijn graphs over sequence reads, as Spark DataFrames."""
