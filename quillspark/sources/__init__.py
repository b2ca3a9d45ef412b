"""Stores, file formats and codecs."""
