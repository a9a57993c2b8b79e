"""Streaming forms of ingest, lifecycle and velocity."""
