"""Structured Streaming forms of the append-only judgment journal and of event windows."""
