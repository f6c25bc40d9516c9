"""Folders of files: crawl, exclusion, incremental skip, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.functions.text import chunks, tokens
from memoria.operators.notes import entities
from memoria.sources.shared import exists
from memoria.sources.shipping import ship_package

#: Folder names that are never read.
EXCLUDED_FOLDERS = [
    "node_modules", ".git", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", "out", ".next", ".cache", "target",
    ".obsidian", ".idea", ".vscode", "checkpoints", "wandb", ".ipynb_checkpoints", "site-packages",
]
#: Parts of paths (in any case) that mark copies and backups, which are skipped.
SKIPPED_PARTS = ["- copy", "copy (", "_copy", " (copy)", "backup", " - bak", ".bak", " - old", "(old)"]


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    """(path, project, name, size, modified, sha) of every file; a project is a folder right below `folder`, null for files beside it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", project_of(F.col("path"), folder).alias("project"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"))


def project_of(path: Column, folder: str) -> Column:
    """The first folder of a path below `folder`, whatever characters that has; paths may begin with a scheme."""
    prefix = folder.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    at = F.locate(prefix, path)
    below = F.substring(path, at + len(prefix), F.length(path))
    return F.when((at > 0) & F.contains(below, F.lit("/")), F.split_part(below, F.lit("/"), F.lit(1)))


def is_readable(path: Column) -> Column:
    """Not in an excluded folder and without a skipped part."""
    in_excluded = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_FOLDERS)))
    skipped = F.exists(F.array(*map(F.lit, SKIPPED_PARTS)), lambda part: F.contains(F.lower(path), part))
    return ~in_excluded & ~skipped


def is_captured(folder: Column, excluded: list[str], own: Column) -> Column:
    """Whether a session is captured: its folder isn't one of `excluded` or below it, and it wasn't begun by this library itself."""
    inside = lambda e: (folder == e) | folder.startswith(e.rstrip("/") + "/")
    shut = F.lit(False)
    for e in excluded:
        shut = shut | inside(e)
    return ~F.coalesce(shut, F.lit(False)) & ~F.coalesce(own, F.lit(False))


def ingested(spark: SparkSession, folder: str, index: DataFrame | None = None, size: int = 200, step: int = 180) -> DataFrame:
    """(path, project, sha, chunk, words) of the readable text files below `folder` whose content `index(path, sha)` hasn't got."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(is_readable(F.col("path")))
    texts = found.select("path", project_of(F.col("path"), folder).alias("project"), F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("body"))
    new = texts if index is None else unseen(texts, index)
    return new.select("path", "project", "sha", F.posexplode(chunks(tokens(F.col("body")), size, step)).alias("chunk", "words"))


def table_columns(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """(table, place, column, type) of each column; read from the schemas alone."""
    return [(name, i, c, kind) for name, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]


def unseen(items: DataFrame, index: DataFrame, path: str = "path", sha: str = "sha") -> DataFrame:
    """Items whose path and content the index doesn't have."""
    return items.join(index.select(path, sha), [path, sha], "left_anti")


def stale(index: DataFrame, items: DataFrame, path: str = "path") -> DataFrame:
    """Index rows whose file is gone."""
    return index.join(items.select(path).distinct(), path, "left_anti")


def append_log(df: DataFrame, path: str) -> None:
    """Rows with a time stamp at the end of a log."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def replace_version(df: DataFrame, path: str, moment: datetime | None = None) -> str:
    """Writes a new version beside the old ones and returns its path; readers take the latest."""
    version = f"{path}/version={(moment or datetime.now(UTC)).strftime('%Y%m%dT%H%M%S')}"
    df.write.mode("errorifexists").parquet(version)
    return version


def route_by_flag(df: DataFrame, flag: str, path: str) -> None:
    """Rows to one folder for each value of a flag."""
    df.write.partitionBy(flag).mode("overwrite").parquet(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], out: str) -> None:
    """The table at `path` (none yet: an empty one) with new rows put in or over it, written whole to `out`; `upsert_parts` writes only what changes."""
    if exists(spark, path):
        old = spark.read.parquet(path)
        new = old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    new.write.mode("overwrite").parquet(out)


#: Folders that the keys of an upserted table are dealt to, unless its first write says otherwise.
PARTS = 64


def upsert_parts(spark: SparkSession, new: DataFrame, path: str, keys: list[str], time: str, parts: int = PARTS) -> None:
    """Puts rows into the table at `path`, which may not exist yet; of rows of a key the latest by `time` stays.

    Keys are dealt by their hash to the folders of the table, whose number the first write settles. Only folders that new rows fall into are read and
    written again, each replaced as a whole; the files of the others stay. Of rows with equal times the new one stays, of such in
    `new` the largest by all columns; a null time is before all others, and null keys are equal to each other.
    """
    from memoria.sources.shared import written

    if exists(spark, f"{path}/_parts"):
        parts = spark.read.schema("parts int").json(f"{path}/_parts").first()["parts"]
    else:
        spark.range(1).select(F.lit(parts).alias("parts")).coalesce(1).write.json(f"{path}/_parts")
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    fresh = new.withColumns({"part": part, "_fresh": F.lit(1)})
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())
    if any(exists(spark, f"{path}/part={p}") for p in touched):
        old = spark.read.parquet(path).filter(F.col("part").isin(touched)).withColumn("_fresh", F.lit(0))
        fresh = old.unionByName(fresh, allowMissingColumns=True)
    columns = [c for c in fresh.columns if c not in (*keys, "part", "_fresh")]
    order = F.struct(F.col(time).isNotNull(), time, "_fresh", F.xxhash64(*columns), *[F.to_json(F.struct(c)) for c in columns])
    latest = fresh.groupBy("part", *keys).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(*keys, "_row.*", "part")
    # Written apart first: the folders are read to the end before one is replaced, also where a task runs again.
    written(latest, "upsert").repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_facts(facts: DataFrame, folder: str) -> None:
    """Facts as JSON lines: clinical ones to `clinical`, the others to `facts`; a null flag counts as clinical. The people and themes of the others go to `entities`."""
    clinical = F.coalesce("clinical", F.lit(True))
    facts.filter(~clinical).drop("clinical").write.mode("overwrite").json(f"{folder}/facts")
    facts.filter(clinical).drop("clinical").write.mode("overwrite").json(f"{folder}/clinical")
    if {"bucket", "statement", "evidence"} <= set(facts.columns):
        entities(facts.filter(~clinical)).write.mode("overwrite").json(f"{folder}/entities")


def write_tiered(df: DataFrame, is_cold: Column, path: str) -> None:
    """One folder for each tier, so that reading the hot one never opens the cold one."""
    df.withColumn("tier", F.when(is_cold, "cold").otherwise("hot")).write.partitionBy("tier").mode("overwrite").parquet(path)


def hot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("tier = 'hot'").drop("tier")


def write_graph(notes: DataFrame, links: DataFrame, path: str) -> None:
    """The graph as two tables: `vertices` of notes(page_id, title) and `edges` of links(page_id, dst), unresolved ones left out."""
    notes.select(F.col("page_id").alias("id"), "title").write.mode("overwrite").parquet(f"{path}/vertices")
    links.filter("dst is not null").select(F.col("page_id").alias("src"), "dst").distinct().write.mode("overwrite").parquet(f"{path}/edges")


def reindexed(items: DataFrame, index: DataFrame, force: bool = False, key: str = "path", sha: str = "sha") -> DataFrame:
    """What is to be embedded: items whose content the index hasn't got, or all of them if forced."""
    return items if force else unseen(items, index, key, sha)


def write_files(files: DataFrame, folder: str) -> int:
    """Each row of files(name, body) as a file of that name in `folder`, in any store that pyarrow reaches; returns how many.

    A file is written under another name and then moved, so that a task that runs again, or is lost half-way, leaves whole files alone. Names may hold folders.
    """
    from memoria.streaming.changes import store_of

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                path = f"{base.rstrip('/')}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write((body or "").encode())
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    ship_package(files.sparkSession)
    return files.filter("name is not null").select("name", "body").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
