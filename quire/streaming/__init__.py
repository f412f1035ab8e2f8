"""The payload scan over a folder that is still being filled."""
