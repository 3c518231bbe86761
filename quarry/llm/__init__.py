"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage imports it.  Every operator is a plain function over DataFrames
with its own general interface; `queries` holds the thin `opN_<name>` queries and their SQL.
"""
