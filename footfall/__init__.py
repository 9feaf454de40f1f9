"""footfall: demand and staffing analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame.  ``keys`` names the
columns that identify one series (default ``("site_id",)``, may be empty) and
``as_of`` is the explicit "now", so a result repeats exactly.
"""

__version__ = "0.1.0"
