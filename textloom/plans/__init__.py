"""End-to-end flows (ingest, preview, search) and the registered queries."""
