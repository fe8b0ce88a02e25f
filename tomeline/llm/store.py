"""Intermediate tables in the folder that all executors share."""

from ..store import discard, materialise, shared_dir

__all__ = ["discard", "materialise", "shared_dir"]
