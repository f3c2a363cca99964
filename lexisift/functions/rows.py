"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: str | Column, name: str, *keep: str | Column, position: str | None = None) -> DataFrame:
    """One row per element. The planner would test the array for elements before it is exploded, and for that test make the
    array a second time, however costly it is; an outer explode whose empty rows are dropped spares that."""
    c = F.col(array) if isinstance(array, str) else array
    if position:
        return df.select(*keep, F.posexplode_outer(c).alias(position, name)).filter(F.col(position).isNotNull())
    return df.select(*keep, F.explode_outer(F.transform(c, lambda x: F.struct(x.alias("v")))).alias("_e")).filter(F.col("_e").isNotNull()).withColumn(name, F.col("_e.v")).drop("_e")
