"""Table reconciliation, key/value reshaping, table checks and SQL-script lineage on Spark.

Every operator takes and returns DataFrames (or Columns); nothing runs until an
action is called, except where a docstring says a check job is started.
"""

__version__ = "0.1.0"
