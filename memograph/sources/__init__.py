"""Readers, writers and the views built over the driver tables."""
