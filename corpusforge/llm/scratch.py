"""Intermediate tables in the folder that the whole cluster shares."""

from corpusforge.sources.scratch import cut, drop, forget, free_shuffles, shared_dir

__all__ = ["cut", "drop", "forget", "free_shuffles", "shared_dir"]
