"""Readers, importers and sinks."""
