"""Matching over streams."""
