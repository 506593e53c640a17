"""Filters as values: their tree, their interval normal form, and what can be proven about them."""
