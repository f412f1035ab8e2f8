"""Landed payloads as tables."""
