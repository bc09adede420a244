"""Sinks: stored tables, quarantine tables, JDBC."""
