"""Readers and writers for tables, documents, inventories, manifests and vocabularies."""
