"""Operators on DataFrames: loci, ranges, expression, co-expression, ontologies, overlap, graphs."""
