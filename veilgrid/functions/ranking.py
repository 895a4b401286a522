"""Places in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.sources.scratch import kept


def with_place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds places from 1 by ``order``, which must tell all rows apart.

    Rows are dealt by ranges of the order and written; each range numbers its own rows,
    and the ranges' counts, one row a range, give what lies before it.
    """
    keys = [f"key{k}_" for k in range(len(order))]
    named = df.withColumns(dict(zip(keys, order)))
    held = kept(named.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()))
    counts = held.groupBy("range_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(*keys))
    return held.withColumn("in_", inside).join(F.broadcast(before), "range_").withColumn(name, F.col("before_") + F.col("in_")).drop("range_", "in_", "before_", *keys)
