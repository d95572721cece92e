"""Where queries put what they write."""

from tidemark.storage import folder

__all__ = ["folder"]
