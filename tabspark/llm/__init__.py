"""Operators for preparing text corpora, with one query each."""
