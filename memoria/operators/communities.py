"""Communities of a weighted graph by modularity, level by level, as Louvain does it.

A level starts with each node in a community of its own. In every round each node weighs the communities that its links lead to: moving there gains its weight of
links into it less what chance would give, by the degrees. Were all to move at once, neighbours would swap places for ever; so only nodes whose hash, with the
round's number, is even may move, the others in the next one, and a round that doesn't raise modularity is taken back. After two such rounds the level ends, each community becomes one
node (its inner links a loop), and the next level starts on that smaller graph, until a level raises nothing.

All is joins and sums over links and nodes; each round is written, so lineage and plans stay short. Equal gains go to the smallest community.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria.sources.shared import written

LEAST_GAIN = 1e-9
ROUNDS, LEVELS = 12, 8


def may_move(node: str, turn: int):
    """Which half of the nodes a round lets go; the round after an even one lets the others go."""
    return (F.crc32(F.concat_ws(":", F.col(node).cast("string"), F.lit(turn // 2)).cast("binary")) + turn) % 2 == 0


def _weights(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, com, weight): what each node's links to others weigh, by the community that they lead to."""
    there = placed.select(F.col("node").alias("dst"), "com")
    return links.filter("src <> dst").join(there, "dst").groupBy(F.col("src").alias("node"), "com").agg(F.sum("weight").alias("weight"))


def modularity(links: DataFrame, placed: DataFrame) -> float:
    """Of links(src, dst, weight), each given both ways and loops once with all of their weight, and placed(node, com)."""
    here, there = placed.select(F.col("node").alias("src"), F.col("com").alias("a")), placed.select(F.col("node").alias("dst"), F.col("com").alias("b"))
    by = links.join(here, "src").join(there, "dst").groupBy(F.col("a").alias("com")).agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("own"))
    sums = by.agg(F.sum("all").alias("all"), F.sum("own").alias("own"), F.sum(F.col("all") ** 2).alias("squares")).first()
    return sums["own"] / sums["all"] - sums["squares"] / sums["all"] ** 2 if sums["all"] else 0.0


def _moved(links: DataFrame, degrees: DataFrame, placed: DataFrame, total: float, turn: int) -> DataFrame:
    """`placed` after a round."""
    state = placed.join(degrees, "node")
    sums = state.groupBy("com").agg(F.sum("degree").alias("sum"))
    own = state.select("node", "degree", F.col("com").alias("now"))
    weighed = _weights(links, placed).unionByName(placed.select("node", "com", F.lit(0.0).alias("weight")))
    weighed = weighed.groupBy("node", "com").agg(F.sum("weight").alias("weight"))
    offers = weighed.join(own, "node").join(sums, "com")
    rest = F.col("sum") - F.when(F.col("com") == F.col("now"), F.col("degree")).otherwise(0.0)
    offers = offers.withColumn("gain", F.round(F.col("weight") - F.col("degree") * rest / total, 9))
    best = offers.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "com")).alias("best"), F.max(F.when(F.col("com") == F.col("now"), F.col("gain"))).alias("stay"), F.first("now").alias("now"))
    goes = may_move("node", turn) & (-F.col("best.loss") > F.col("stay") + LEAST_GAIN)
    return best.select("node", F.when(goes, F.col("best.com")).otherwise(F.col("now")).alias("com"))


def communities(links: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS) -> tuple[DataFrame, float]:
    """((node, com), modularity) of an undirected graph of links(src, dst[, weight]).

    Links between the same nodes add up, whichever way they go; a link from a node to itself counts as one both ways. Links with a null end or without a positive weight
    are left out. A community is named by one of its nodes.
    """
    weight = F.col("weight").cast("double") if "weight" in links.columns else F.lit(1.0)
    given = links.select("src", "dst", weight.alias("weight")).filter("src is not null and dst is not null and weight > 0")
    both = given.unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    graph = written(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
    total = graph.agg(F.sum("weight")).first()[0]
    result = written(graph.select(F.col("src").alias("node")).distinct().withColumn("com", F.col("node")), "communities")
    if not total:
        return result, 0.0
    reached = modularity(graph, result)
    for _ in range(levels):
        degrees = written(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")), "degrees")
        placed = degrees.select("node", F.col("node").alias("com"))
        before, failed = reached, 0
        for turn in range(rounds):
            after = written(_moved(graph, degrees, placed, total, turn), "moved")
            q = modularity(graph, after)
            if q > reached + LEAST_GAIN:
                placed, reached, failed = after, q, 0
            elif (failed := failed + 1) == 2:
                break
        if reached <= before + LEAST_GAIN:
            break
        result = written(result.withColumnRenamed("com", "_c").join(placed.select(F.col("node").alias("_c"), "com"), "_c").select("node", "com"), "communities")
        here, there = placed.select(F.col("node").alias("src"), F.col("com").alias("a")), placed.select(F.col("node").alias("dst"), F.col("com").alias("b"))
        graph = written(graph.join(here, "src").join(there, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "links")
    return result, reached
