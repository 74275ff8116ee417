"""The library's queries composed over the driver's tables."""
