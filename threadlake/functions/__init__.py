"""Column functions: all built-ins, so they stay inside generated code."""
