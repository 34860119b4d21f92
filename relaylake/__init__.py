"""Relay analytics on PySpark: events, filters, state resolution, counts, streams and reconciliation."""
