"""The link graph: pages and the targets they link to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria.functions.text import slug


def edges(pages: DataFrame) -> DataFrame:
    """(page_id, target), each once."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("target")).distinct()


def spread_labels(steps: DataFrame, pages: DataFrame, rounds: int) -> DataFrame:
    """(page_id, label): in each round a page takes the least label of the pages it shares a target with.

    A round goes by way of the targets (least label of each, then least of each page's targets), so no pairs of pages are made.
    """
    labels = pages.select("page_id", F.col("page_id").alias("label"))
    for _ in range(rounds):
        by_target = steps.join(labels, "page_id").groupBy("target").agg(F.min("label").alias("least"))
        offered = steps.join(by_target, "target").groupBy("page_id").agg(F.min("least").alias("least"))
        labels = labels.join(offered, "page_id", "left").select("page_id", F.least("label", F.coalesce("least", "label")).alias("label"))
    return labels


def note_names(notes: DataFrame) -> DataFrame:
    """(name, dst): of notes(page_id, title, aliases) each name's note. Titles come before aliases, of equal ones the smallest page_id."""
    names = notes.select("page_id", F.lit(0).alias("rank"), slug(F.col("title")).alias("name")).unionByName(
        notes.select("page_id", F.lit(1).alias("rank"), F.explode("aliases").alias("alias")).select("page_id", "rank", slug(F.col("alias")).alias("name"))
    )
    return names.filter(F.col("name") != "").groupBy("name").agg(F.min(F.struct("rank", "page_id")).alias("m")).select("name", F.col("m.page_id").alias("dst"), (F.col("m.rank") == 0).alias("by_title"))


def resolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(page_id, target, dst, by_title): links(page_id, target) with the note that the target names; dst is null where there is none."""
    return links.withColumn("name", slug(F.col("target"))).join(note_names(notes), "name", "left").select("page_id", "target", "dst", "by_title")


def both_ways(links: DataFrame) -> DataFrame:
    """(page_id, other, n_out, n_back): each two notes that a link joins, seen from either."""
    known = links.filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("page_id")))
    out = known.select("page_id", F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("b"))
    back = known.select(F.col("dst").alias("page_id"), F.col("page_id").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("b"))
    return out.unionByName(back).groupBy("page_id", "other").agg(F.sum("o").alias("n_out"), F.sum("b").alias("n_back"))


def orphan_notes(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(page_id) of notes that no other note links to and that link to none."""
    return notes.select("page_id").join(both_ways(links).select("page_id").distinct(), "page_id", "left_anti")
