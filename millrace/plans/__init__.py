"""Lineage, what the executed plan says, and metrics."""
