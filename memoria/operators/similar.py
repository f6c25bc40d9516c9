"""Near-identical statements: an exact set-similarity join by prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import tokens
from memoria.sources.shared import written

WORDS, SIMILARITY = 5, 0.8


#: Sizes of similar sets are in the same class or in neighbouring ones: classes grow by this factor.
GROWTH = 1 / SIMILARITY


def similar_statements(df: DataFrame, text: str) -> DataFrame:
    """(a, b, similarity) of different statements, named by the md5 of their texts, with Jaccard of at least SIMILARITY.

    Copies fall together first. Shingles of a statement are ordered from rare to common; two similar ones must share one of
    their first n - ceil(SIMILARITY * n) + 1. Shingles that no other statement has come first and are only counted. Those that are left are
    joined within classes of like size, and only where their places leave room for enough others in common; what remains is verified over all shingles.
    """
    texts = df.groupBy(F.md5(F.col(text).cast("binary")).alias("k")).agg(F.first(text).alias("_t"))
    words = texts.select("k", tokens(F.col("_t")).alias("w"))
    size = F.size("w")
    runs = F.when(size >= WORDS, F.transform(F.sequence(F.lit(1), size - WORDS + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, WORDS), " "))))
    # The sets are used three times: made once.
    sets = written(words.select("k", F.array_distinct(F.coalesce(runs, F.array().cast("array<bigint>"))).alias("s")).filter(F.size("s") > 0), "shingle-sets")
    rows = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("g"))
    shared = rows.groupBy("g").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    own = Window.partitionBy("k")
    placed = rows.join(shared, "g").withColumns({"at": F.row_number().over(own.orderBy("f", "g")), "m": F.count(F.lit(1)).over(own)})
    placed = placed.withColumn("at", F.col("at") + F.col("n") - F.col("m"))
    heads = placed.filter(F.col("at") <= F.col("n") - F.ceil(SIMILARITY * F.col("n")) + 1).select("k", "n", "g", "at", F.floor(F.log(F.col("n")) / F.log(F.lit(GROWTH)) + 1e-9).cast("int").alias("c"))
    side = lambda x: heads.select("g", "c", F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"))
    a, b = side("a").withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))), side("b")
    fits = (F.col("a") < F.col("b")) & (F.col("n_a") >= SIMILARITY * F.col("n_b")) & (F.col("n_b") >= SIMILARITY * F.col("n_a"))
    room = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = room * (1 + SIMILARITY) >= SIMILARITY * (F.col("n_a") + F.col("n_b")) - 1e-6
    pairs = a.join(b, ["g", "c"]).filter(fits & enough).select("a", "b").distinct()
    x = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("s_b")), "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - both
    return x.withColumns({"both": both, "union": union}).filter(F.col("both") >= SIMILARITY * F.col("union")).select("a", "b", F.round(F.col("both") / F.col("union"), 6).alias("similarity"))
