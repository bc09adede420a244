"""Whole runs: operators put together, from files to stored tables."""
