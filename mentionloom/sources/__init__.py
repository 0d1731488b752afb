"""Readers and writers of tables, JSON lines and ontology files."""
