"""Numbers of rows in a total order, without one task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import staged


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """``df`` with the place of each row (from 0) among the rows of its group ``by``, in order of ``order``.

    Rows are dealt by ranges of (by, order); counts of each range and group, a small table, give where it begins."""
    by = by or []
    laid = staged(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "numbering")
    counts = laid.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__at"), before.alias("__before"))
    own = F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)) - 1
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = laid.withColumn("__own", own).join(starts, same)
    return out.select(*df.columns, (F.col("__own") + F.col("__before")).cast("long").alias(name))
