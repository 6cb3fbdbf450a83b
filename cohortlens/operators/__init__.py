"""Operators over cohorts: evaluation, analytics, comparison, static checks, ingestion, grounding, review."""
