"""Incremental paths: growing log files and event streams."""
