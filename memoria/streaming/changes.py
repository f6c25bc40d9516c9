"""Changed files as a stream: files that are new, changed in place or gone since the last batch.

Spark's own file source knows a path once and never reads it again. Here each batch ends with a listing of the folder, every path with its time of change
and size, and gives what differs from the listing before. Listings are files in a folder of their own, and a stream's offset is a listing's number, so
offsets stay small, and a batch that runs again after a failure reads the same two listings and gives the same paths.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from memoria.sources.shipping import ship_package

CHANGES = "path string, changed timestamp, gone boolean, body string"


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it of a folder given with or without a scheme."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class Paths(InputPartition):
    """Paths of a task, each with its time of change, or null if it is gone."""

    def __init__(self, paths: list[tuple[str, int | None]]):
        self.paths = paths


class ChangesReader(DataSourceStreamReader):
    def __init__(self, folder: str, listings: str, suffixes: tuple[str, ...], per_task: int):
        self.folder, self.listings, self.suffixes, self.per_task = folder, listings, suffixes, per_task
        self.known: tuple[int, dict[str, list[int]]] | None = None

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _read_listing(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        if self.known and self.known[0] == number:
            return self.known[1]
        store, base = store_of(self.listings)
        with store.open_input_stream(f"{base}/{number:09d}.json") as f:
            return json.loads(f.read())

    def _last_listing(self) -> int:
        store, base = store_of(self.listings)
        store.create_dir(base, recursive=True)
        names = [f.base_name for f in store.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def _list(self) -> dict[str, list[int]]:
        store, base = store_of(self.folder)
        found = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        return {f.path: [f.mtime_ns or 0, f.size] for f in found if f.is_file and f.path.endswith(self.suffixes)}

    def latestOffset(self) -> dict:
        number = self.known[0] if self.known else self._last_listing()
        before, now = self._read_listing(number), self._list()
        if now != before:
            number += 1
            store, base = store_of(self.listings)
            # Whole or not at all: a listing that a lost driver left half-written has another name.
            with store.open_output_stream(f"{base}/{number:09d}.part") as f:
                f.write(json.dumps(now).encode())
            store.move(f"{base}/{number:09d}.part", f"{base}/{number:09d}.json")
        self.known = (number, now)
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[Paths]:
        before, now = self._read_listing(start["listing"]), self._read_listing(end["listing"])
        changed = [(p, v[0]) for p, v in sorted(now.items()) if before.get(p) != v] + [(p, None) for p in sorted(before.keys() - now.keys())]
        return [Paths(changed[i : i + self.per_task]) for i in range(0, len(changed), self.per_task)]

    def read(self, partition: Paths) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path, changed in partition.paths:
            body = None
            if changed is not None:
                try:
                    with store.open_input_stream(path) as f:
                        body = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue  # gone since it was listed; the next listing says so
            moment = datetime.now(UTC) if changed is None else datetime.fromtimestamp(changed / 1e9, UTC)
            yield path, moment, changed is None, body

    def commit(self, end: dict) -> None:
        """Listings before the last two are done with; a batch that runs again may need those."""
        store, base = store_of(self.listings)
        for f in store.get_file_info(pafs.FileSelector(base)):
            if f.base_name.endswith(".json") and int(f.base_name.removesuffix(".json")) < end["listing"] - 1:
                store.delete_file(f.path)

    def stop(self) -> None:
        pass


class Changes(DataSource):
    """Options: path (of the folder), listings (a folder that outlives the stream), suffixes (comma-joined), filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangesReader:
        o = self.options
        suffixes = tuple(s for s in o.get("suffixes", ".md,.txt").split(",") if s)
        return ChangesReader(o["path"].rstrip("/"), o["listings"].rstrip("/"), suffixes or ("",), int(o.get("filesPerTask", "64")))


def changed_files(spark: SparkSession, folder: str, listings: str, suffixes: str = ".md,.txt") -> DataFrame:
    """(path, changed, gone, body) of files below `folder` that are new, changed or gone; `listings` is kept beside the stream's checkpoint."""
    ship_package(spark)
    spark.dataSource.register(Changes)
    return spark.readStream.format("changed_files").option("listings", listings).option("suffixes", suffixes).load(folder)
