"""Intermediate tables of the training-data operators: the library's store."""

from hexflow.store import Scratch, files_for, shared_dir

__all__ = ["Scratch", "files_for", "shared_dir"]
