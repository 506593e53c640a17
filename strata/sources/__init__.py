"""Stores that a resource is backed by."""
