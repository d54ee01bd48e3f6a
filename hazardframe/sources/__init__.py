"""Readers, validation, catalogs and sinks."""
