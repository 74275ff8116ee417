"""Set-based operators over the logical tables; each takes and returns DataFrames."""
