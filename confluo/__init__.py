"""confluo — bring tables with differing headers into one, on Spark.

Catalogue columns, recommend which columns mean the same thing (fuzzy names,
TF-IDF cosine of values), merge them by a column mapping, and profile the
result.  Every operator is a function over DataFrames that runs on the
executors; nothing whole is pulled through the driver.
"""

__version__ = "0.1.0"
