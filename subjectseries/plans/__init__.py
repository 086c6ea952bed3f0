"""User-level queries and pipelines composed from the operators."""
