"""The textual query language."""
