"""Stages of the linking engine: forms, scoring, indexes, matching, evaluation, adjudication, reports."""
