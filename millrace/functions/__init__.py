"""Logical types, operator typing and scalar expressions."""
