"""Profiles pinned to folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoria.model import PROFILES, SCOPES


def folder_of(path: Column) -> Column:
    """A path without a slash at its end or twice in a row; the root is `/`."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/"))


def folders_above(path: Column) -> Column:
    """A path and every folder above it, the root first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def pinned(df: DataFrame, pins: DataFrame, path: str = "path") -> DataFrame:
    """`df` with the profile of the longest of pins(pin, profile) that is the path or a folder above it; null where none is.

    Each different path is taken apart into its folders, which meet any number of pins by equality. Of several profiles of one folder the one
    that sees least counts, of such the first by name; one of an unknown name sees nothing and so comes first.
    """
    least = F.lit(len(SCOPES) + 1)
    for name, ceiling in PROFILES.items():
        least = F.when(F.col("profile") == name, SCOPES.index(ceiling) + 1).otherwise(least)
    strictest = pins.filter("pin is not null and profile is not null").select(folder_of(F.col("pin")).alias("_folder"), F.struct((-least).alias("_seen"), "profile").alias("_p"))
    strictest = strictest.groupBy("_folder").agg(F.min("_p").alias("_p"))
    folders = df.select(path).distinct().select(path, F.explode(folders_above(F.col(path))).alias("_folder"))
    chosen = folders.join(strictest, "_folder").groupBy(path).agg(F.max_by("_p", F.length("_folder"))["profile"].alias("profile"))
    return df.drop("profile").join(chosen, path, "left")
