"""A9: a table sent inline, column by column (``{name, columns: [{column_name, data}]}``).

The payload already sits in driver memory (it arrived in a request); it is
turned into rows once.  Row count is the length of the first column; a
later column of another length raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from confluo.errors import InlineTableError


def inline_table(spark: SparkSession, payload: dict) -> DataFrame:
    cols = payload.get("columns") or []
    if not cols:
        raise InlineTableError("inline table without columns")
    n = len(cols[0]["data"])
    for c in cols[1:]:
        if len(c["data"]) != n:
            raise InlineTableError(f"column {c['column_name']} has {len(c['data'])} values, expected {n}")
    schema = T.StructType([T.StructField(c["column_name"], T.StringType(), True) for c in cols])
    rows = [tuple(c["data"][i] for c in cols) for i in range(n)]
    return spark.createDataFrame(rows, schema)
