"""Readers of log files and of the small files beside them."""
