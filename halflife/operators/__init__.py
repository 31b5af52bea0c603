"""Composite operators Spark lacks as one call: skew-safe neighbours, log ingest, calendars."""
