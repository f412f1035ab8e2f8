"""Operators for preparing training data, each with its own general interface."""
