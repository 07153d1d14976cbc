"""Operators for preparing text collections; nothing outside this package imports it."""
