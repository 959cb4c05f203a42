"""Readers for tables and documents."""

from rowan.sources.readers import load, read_source, sniff_delimiter, write_source

__all__ = ["load", "read_source", "sniff_delimiter", "write_source"]
