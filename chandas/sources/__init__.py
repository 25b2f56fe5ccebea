"""Readers, writers and the catalog of loaded hymns."""
