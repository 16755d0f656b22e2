"""Readers and writers of catalog extracts, usage logs, lineage documents and derived tables."""
