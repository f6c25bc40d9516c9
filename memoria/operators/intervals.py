"""Facts over time: versions as half-open intervals, reconciliation, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def closed_intervals(versions: DataFrame, keys: list[str], start: str, tie: str) -> DataFrame:
    """Adds valid_from and valid_to: a version holds until the next one of its key starts; the last one is open."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    return versions.withColumns({"valid_from": F.col(start), "valid_to": F.lead(start).over(order)})


def valid_at(moment: Column) -> Column:
    return (F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))


def reconciled(current: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key with its old and new value and what to do: contradictions are flagged, never overwritten."""
    a = current.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_has_old"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_has_new"))
    status = F.when(F.col("_has_new").isNull(), "kept").when(F.col("_has_old").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("conflict")
    return a.join(b, keys, "full_outer").withColumn("status", status).drop("_has_old", "_has_new")
