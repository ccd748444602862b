"""Lakeloom: a versioned lakehouse catalog and table engine on plain PySpark."""
