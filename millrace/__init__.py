"""Event-stream ingestion and analytics on Spark DataFrames."""

from millrace.session import configure

__all__ = ["configure"]
