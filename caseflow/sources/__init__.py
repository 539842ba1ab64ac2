"""Scans, sinks, fixed dimension tables and the test views."""
