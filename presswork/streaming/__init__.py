"""Refresh of snapshots by Structured Streaming."""
