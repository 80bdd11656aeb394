"""Incremental ingestion by micro-batches, and event-time windows."""
