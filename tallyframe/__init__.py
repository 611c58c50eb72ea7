"""tallyframe: ledger indexing and monitoring analytics as Spark DataFrame jobs.

Every operator is a function DataFrame -> DataFrame with explicit arguments
(tip, asof, now, limits); nothing reads the wall clock or collects rows.
"""

__version__ = "0.1.0"
