"""Part of ontoloom."""
