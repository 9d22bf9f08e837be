"""Query and ingest plans."""
