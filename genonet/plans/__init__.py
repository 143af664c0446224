"""Whole jobs out of the operators: building networks, mapping SNPs, overlap, health reports."""
