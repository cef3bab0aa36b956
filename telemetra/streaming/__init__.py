"""Structured Streaming jobs: continuous ingest and incremental curation."""
