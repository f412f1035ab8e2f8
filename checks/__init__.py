"""Corpora derived from the check tables, and the registered queries with their SQL."""
