"""Whole dataflows: ingestion, search, verification, and the catalogue of registered queries."""
