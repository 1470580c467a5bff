"""Versioned tables, commits and rollbacks."""
