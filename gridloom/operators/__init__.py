"""Operators on feature tables (``geometry`` as WKB) and cell tables."""
