"""tavola — listing intelligence on Spark.

Every operator is a function from DataFrames (and plain Python parameters)
to a DataFrame or a Column, built from Spark SQL expressions, joins,
aggregates and Spark ML, so Catalyst plans it and the work runs on the
executors.  See README.md for the operator map.
"""

__version__ = "0.1.0"
