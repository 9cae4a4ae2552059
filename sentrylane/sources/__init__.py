"""Readers, seeded dimension tables and writers."""
