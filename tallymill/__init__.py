"""tallymill: cleaning, analytics and telemetry operators for PySpark DataFrames.

Every operator takes DataFrames and column names and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
