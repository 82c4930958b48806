"""Runs end to end, the query registry and its SQL."""
