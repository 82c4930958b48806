"""Datasets by name: schemas, loading with column pruning, and writing."""

from .stored import fresh_path, shared_folder, stored
from .tables import DATASETS, cached, list_parts, load, read_stage, write_csv, write_stage

__all__ = ["DATASETS", "cached", "fresh_path", "list_parts", "load", "read_stage", "shared_folder", "stored", "write_csv", "write_stage"]
