"""Operators: filters, joins, aggregates and transforms over genomic DataFrames."""
