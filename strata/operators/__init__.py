"""Queries as values, compiled to DataFrame plans."""
