"""Readers and writers: export documents, versioned tables, snapshots."""
