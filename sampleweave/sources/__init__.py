"""Readers, writers and seeded generators."""
