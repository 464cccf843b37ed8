"""Scans, catalogues and sinks."""
