"""Incremental refresh of the fact-driven KPIs with Structured Streaming."""
