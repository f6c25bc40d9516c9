"""An inverted-file index over vectors: cells around centres, of which a search reads the few closest to its query.

Centres are fitted on a sample of at most about SAMPLE vectors; every vector is then put into the cell of its closest centre (by cosine), one folder for each
cell. Vectors added later go into the same cells. How many cells a search probes is found by holding about CALIBRATION stored vectors, as queries, against all
vectors: the fewest cells that hold the wanted share of true neighbours. `memoria.functions.vectors.nearest` stays the exact way.

Vectors that change or go stay in their cells until the index is built anew from `stored`, but rows say up to which write they are dead, and no search sees them. A write counts from its row in
`writes` on, which comes last, so what a lost driver left behind is never read. One writer at a time, any number of searches beside it.

Vectors are of one length (that of most in the sample); null ones and others aren't stored, and a query of another length finds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.vectors import _unit, as_queries, best_pairs, matrix, nearest, packed
from memoria.sources.shared import exists, written
from memoria.sources.shipping import ship_package

SAMPLE, CALIBRATION = 50_000, 300
#: Cells where no number is given: the root of the number of vectors, within these bounds.
FEWEST, MOST = 4, 4096
RECALL = 0.95
WRITES = "write string, at bigint, batch string"


def hash_share(column: Column, share: float) -> Column:
    """True for about that share of rows."""
    return F.xxhash64(column).cast("double") / 2.0**64 + 0.5 < share


@dataclass
class Cells:
    """A written index: its folder, centres (a row a cell), and how many cells a search probes."""

    path: str
    centres: np.ndarray
    probes: int

    def ordered(self, spark: SparkSession, vector: Column, count: int) -> Column:
        """The `count` closest cells of a vector, closest first; null for a vector that the index can't hold."""
        ship_package(spark)
        sent = spark.sparkContext.broadcast(self.centres)

        @F.arrow_udf("array<int>")
        def closest(vectors: pa.Array) -> pa.Array:
            centres = sent.value
            at, data = matrix(vectors, centres.shape[1])
            order = np.argsort(-np.round(_unit(data) @ centres.T, 9), axis=1, kind="stable")[:, :count].astype(np.int32)
            sizes = np.zeros(len(vectors), np.int64)
            sizes[at] = order.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(order.ravel()))
            return pc.if_else(pa.array(sizes > 0), lists, pa.scalar(None, lists.type))

        return closest(vector)

    def add(self, vectors: DataFrame) -> None:
        """Puts vectors(id, vector[, rank]) that the index doesn't have into their cells; a cell of many vectors is dealt to many files."""
        self._put(vectors, None, None)

    def replace(self, vectors: DataFrame, gone: DataFrame | None = None, batch: str | None = None) -> None:
        """Puts vectors in place of those of the same ids, new ones too, and takes out those of gone(id); all of it counts at once.

        Of rows with one id that with the largest vector (then rank) by order counts, null and unfit ones least; where the index can't hold it, the id is taken out. An id
        that is in both stays. With the name of a batch that has been put in before, nothing happens.
        """
        spark = vectors.sparkSession
        if batch is not None and any(r["batch"] == batch for r in self._writes(spark)):
            return
        ranked = ["rank"] if "rank" in vectors.columns else []
        fit = F.coalesce(F.size("vector") == self.centres.shape[1], F.lit(False))
        one = vectors.filter("id is not null").groupBy("id").agg(F.max(F.struct(fit.alias("fit"), "vector", *ranked)).alias("v"))
        one = written(one.select("id", "v.vector", *[f"v.{c}" for c in ranked]), "replacing")
        ids = one.select("id")
        self._put(one, ids if gone is None else ids.unionByName(gone.select("id").filter("id is not null")).distinct(), batch)

    def remove(self, vectors: DataFrame, gone: DataFrame) -> None:
        """Takes out gone(id); `vectors` tells the columns alone."""
        self.replace(vectors.limit(0), gone)

    def _put(self, vectors: DataFrame, dead: DataFrame | None, batch: str | None) -> None:
        spark, write = vectors.sparkSession, f"w{uuid.uuid4().hex}"
        at = 1 + max((r["at"] for r in self._writes(spark)), default=0)
        placed = vectors.withColumn("cell", F.get(self.ordered(spark, F.col("vector"), 1), 0)).filter("cell is not null").withColumns({"write": F.lit(write), "at": F.lit(at).cast("bigint")})
        placed.repartitionByRange("cell", "id").write.partitionBy("cell").mode("append").parquet(f"{self.path}/vectors")
        if dead is not None:
            dead.select("id", F.lit(at).cast("bigint").alias("dead_before"), F.lit(write).alias("write")).write.mode("append").parquet(f"{self.path}/dead")
        spark.createDataFrame([(write, at, batch)], WRITES).coalesce(1).write.mode("append").parquet(f"{self.path}/writes")

    def _writes(self, spark: SparkSession) -> list[Row]:
        """A row for each write since the index was built."""
        path = f"{self.path}/writes"
        return spark.read.schema(WRITES).parquet(path).collect() if exists(spark, path) else []

    def stored(self, spark: SparkSession) -> DataFrame:
        """(id, vector[, rank], cell) of the vectors that the index has."""
        schema = spark.read.parquet(f"{self.path}/shape").schema.add("write", "string").add("at", "long").add("cell", "integer")
        done = [r["write"] for r in self._writes(spark)]
        rows = spark.read.schema(schema).parquet(f"{self.path}/vectors").filter(F.col("write").isin(*done))
        if exists(spark, f"{self.path}/dead"):
            dead = spark.read.parquet(f"{self.path}/dead").filter(F.col("write").isin(*done)).groupBy("id").agg(F.max("dead_before").alias("dead_before"))
            rows = rows.join(dead, "id", "left").filter(F.col("dead_before").isNull() | (F.col("at") >= F.col("dead_before"))).drop("dead_before")
        return rows.drop("write", "at")

    def search(self, queries: DataFrame, keep: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, place): the `keep` closest vectors in the probed cells for each of queries(query_id, vector[, least_rank]).

        Query ids are taken to differ. Only the folders of probed cells are read; within them the search is exact.
        """
        spark = queries.sparkSession
        least = F.col("least_rank").cast("bigint") if "least_rank" in queries.columns else F.lit(None).cast("bigint")
        asked = queries.filter("query_id is not null").select("query_id", "vector", least.alias("least"), F.explode(self.ordered(spark, F.col("vector"), probes or self.probes)).alias("cell"))
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # no more than there are cells
        stored = self.stored(spark).filter(F.col("cell").isin(wanted))
        rank = F.col("rank").cast("bigint") if "rank" in stored.columns else F.lit(None).cast("bigint")
        dealt = asked.repartitionByRange("cell", "query_id").sortWithinPartitions("cell")
        mine = packed(dealt.select("cell", F.col("query_id").alias("id"), F.lit(0).alias("tag"), F.col("least").alias("level"), "vector"))
        theirs = packed(stored.select("cell", "id", F.lit(0).alias("tag"), rank.alias("level"), "vector"))
        found = best_pairs(theirs.join(as_queries(mine), ["cell", "size"]), keep, "rank" in stored.columns and "least_rank" in queries.columns).drop("asked")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def build(vectors: DataFrame, path: str, cells: int | None = None, keep: int = 4, recall: float = RECALL, seed: int = 7) -> Cells:
    """Fits centres, writes vectors(id, vector[, rank]) to `path` cell by cell, and finds how many cells to probe for `keep` neighbours."""
    spark = vectors.sparkSession
    n = vectors.count()
    own = vectors.filter("id is not null and vector is not null")
    drawn = own.filter(hash_share(F.col("id"), SAMPLE / max(n, 1))).select("vector", F.size("vector").alias("size"))
    sizes = drawn.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 0
    usable = drawn.filter((F.col("size") == size) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    cells = cells or int(min(MOST, max(FEWEST, round(n**0.5))))
    features = usable.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    # Given as points in sparse places, equal ones among them, a fit may find fewer centres than asked for.
    centres = KMeans(k=max(cells, 2), seed=seed, maxIter=10, distanceMeasure="cosine").fit(features).clusterCenters() if sizes and not features.isEmpty() else [np.zeros(size)]
    index = Cells(path, _unit(np.array(centres, np.float64).reshape(len(centres), size)), len(centres))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    own.select("id", "vector", *(["rank"] if "rank" in own.columns else [])).limit(0).write.parquet(f"{path}/shape")
    index.add(own.select("id", "vector", *(["rank"] if "rank" in own.columns else [])))
    index.probes = calibrated(index, spark, n, keep, recall)
    spark.createDataFrame([(index.probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    return index


def calibrated(index: Cells, spark: SparkSession, n: int, keep: int, recall: float) -> int:
    """The fewest cells that hold the share `recall` of the `keep` nearest others of about CALIBRATION stored vectors.

    Where vectors have ranks, only those of the highest rank count as others: a search that sees less finds its neighbours further away.
    """
    stored = index.stored(spark)
    asked = stored.filter(hash_share(F.col("id"), CALIBRATION / max(n, 1))).select(F.col("id").alias("query_id"), "vector")
    if "rank" in stored.columns:
        asked = asked.withColumn("least_rank", F.lit(stored.agg(F.max("rank")).first()[0]).cast("bigint"))
    true = nearest(stored.drop("cell"), asked, keep + 1).filter("id <> query_id")
    ordered = asked.select("query_id", index.ordered(spark, F.col("vector"), len(index.centres)).alias("cells"))
    place = F.array_position("cells", F.col("cell"))
    needed = true.join(ordered, "query_id").join(stored.select("id", "cell"), "id").groupBy(place.cast("int").alias("place")).count().orderBy("place").collect()
    total, held = sum(r["count"] for r in needed), 0
    for r in needed:
        held += r["count"]
        if held >= recall * total:
            return r["place"]
    return len(index.centres)


def opened(spark: SparkSession, path: str) -> Cells:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Cells(path, np.array([r["centre"] for r in centres], np.float64), spark.read.parquet(f"{path}/probes").first()["probes"])
