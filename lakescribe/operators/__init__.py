"""Operators from DataFrame to DataFrame over the catalogue and over the data."""
