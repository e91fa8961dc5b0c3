"""Readers, writers and the adapter over the driver tables."""
