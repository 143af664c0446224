"""Readers, writers and the dataset catalog."""
