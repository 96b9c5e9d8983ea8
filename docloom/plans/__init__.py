"""Retrieval plans and run-time options."""
