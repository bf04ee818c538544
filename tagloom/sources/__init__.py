"""Catalog and log sources and sinks."""
