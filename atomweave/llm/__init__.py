"""Operators for cleaning, searching and encoding large text corpora."""
