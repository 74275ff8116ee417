"""Training-data operators: thirteen corpus operators, each a Spark job.

Nothing outside this folder imports it.  Every operator takes a DataFrame plus
column names and returns a DataFrame; ``queries.py`` holds the thin registered
queries (``op1_...`` to ``op13_...``) and their SQL.
"""
