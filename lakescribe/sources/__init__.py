"""Readers and normalisers that yield the flat tables of ``lakescribe.model``."""
