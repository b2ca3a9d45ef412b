"""Literals and conversions."""
