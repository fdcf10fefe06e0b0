"""Whole plans: ingestion, article queries and snapshots."""
