"""Catalog, text records, bulk data and result output."""
