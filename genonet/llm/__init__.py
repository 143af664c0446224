"""Training-data operators: decontamination, near duplicates, scans, tokens, text extraction.

Nothing else in the package imports this subpackage.
"""
