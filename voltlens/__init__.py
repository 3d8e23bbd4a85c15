"""voltlens: analytics for electric-vehicle charging operations on PySpark.

Every operator takes DataFrames and returns a DataFrame.  Plans stay lazy
unless a docstring says otherwise, nothing is registered in the catalog and no
row ever passes through Python.
"""

__version__ = "0.1.0"
