"""Readers: tables, delimited files, XES files, streams."""
