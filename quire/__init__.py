"""Documentary-corpus jobs on Spark: walk, split, describe, validate, export."""

from quire.session import checkpoint_root, configure, materialize

__all__ = ["checkpoint_root", "configure", "materialize"]
