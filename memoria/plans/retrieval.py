"""Ranked retrieval: dense, lexical, fused, reranked, and the decision to inject or stay silent.

Query sets are the rows whose id is divisible by 100, held against all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import tokens
from memoria.functions.vectors import nearest
from memoria.model import FIXTURE_THRESHOLD, PROFILES, RANK_SQL, SCOPE_SQL, SCOPES, SETTINGS, derived_scope, scope_rank
from memoria.operators.cells import Cells, build
from memoria.operators.lexical import Terms, bm25, bm25_where_lying, document_counts, rarest, reciprocal_rank_fusion
from memoria.operators.postings import Postings
from memoria.plans.registry import Tables, query
from memoria.sources.shared import shared_folder, written
from memoria.tools import gate

EVERY = 100
#: The gate's threshold for the given vectors, in place of SETTINGS.threshold.
GATE_THRESHOLD = 0.3
K, POOL = SETTINGS.top_k, SETTINGS.rerank_pool


def ranked_vectors(t: Tables) -> DataFrame:
    """Vectors with the rank of their scope; vec_id is taken for a doc_id, a convention of the given tables."""
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), scope_rank(derived_scope(F.col("vec_id"))).cast("bigint").alias("rank"))


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def rank_of(ceiling: str) -> int:
    return SCOPES.index(ceiling) + 1


VECTORS_SQL = f"v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, {RANK_SQL.format(SCOPE_SQL.replace('doc_id', 'vec_id'))} AS rank FROM embeddings)"


@query(f"""
WITH {VECTORS_SQL}, s AS (
  SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score
  FROM v JOIN v q ON q.id % 100 = 0 WHERE v.rank >= {rank_of('professional')}
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)
SELECT query_id, id, score, place::BIGINT AS place FROM r WHERE place <= {K} AND score >= {FIXTURE_THRESHOLD}
""")
def dense_topk_scoped(t: Tables) -> DataFrame:
    """The closest permitted vectors of each query above the threshold; the ceiling holds before ranking."""
    asked = vector_queries(t).withColumn("least_rank", F.lit(rank_of(PROFILES["work"])).cast("bigint"))
    found = nearest(ranked_vectors(t), asked, K)
    return found.filter(F.col("score") >= FIXTURE_THRESHOLD).select("query_id", "id", "score", F.col("place").cast("bigint").alias("place"))


BM25_SQL = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM len) / (SELECT count(*) FROM documents)::DOUBLE AS mean_length),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
gain AS (
  SELECT doc_id, term, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean_length)) AS gain
  FROM tf JOIN df USING (term) JOIN len USING (doc_id), stats
)"""


@query(f"""
WITH {BM25_SQL}, q AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark WHERE item_id % 100 = 0
), s AS (SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM q JOIN gain USING (term) GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT query_id, doc_id, score, place::BIGINT AS place FROM r WHERE place <= 20
""")
def bm25_topk(t: Tables) -> DataFrame:
    """The 20 best documents for the words of each query item."""
    asked = t.benchmark.filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return bm25(Terms(t.documents, asked=asked), asked, 20).select("query_id", "doc_id", "score", F.col("place").cast("bigint").alias("place"))


@query(f"""
WITH {BM25_SQL}, q AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark WHERE item_id % 100 = 0
), s AS (SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM q JOIN gain USING (term) GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT query_id, doc_id, score, place::BIGINT AS place FROM r WHERE place <= {K}
""")
def saved_index_topk(t: Tables) -> DataFrame:
    """The best documents for the words of each query item, from a saved index that got its documents in two parts."""
    index = Postings(t.spark, f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}")
    index.add(t.documents.filter("doc_id % 3 <> 0"))
    index.add(t.documents.filter("doc_id % 3 = 0"))
    asked = t.benchmark.filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return index.search(asked, K).select("query_id", "doc_id", "score", F.col("place").cast("bigint").alias("place"))


@query(f"""
WITH {BM25_SQL}, q AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark WHERE item_id % 100 = 0
), s AS (SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM q JOIN gain USING (term) GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT query_id, doc_id, score, place::BIGINT AS place FROM r WHERE place <= {K}
""")
def edited_index_topk(t: Tables) -> DataFrame:
    """The same from a saved index whose documents first had the text of others, and then got their own, some of them twice, while others came and went."""
    index = Postings(t.spark, f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}")
    docs = t.documents.select("doc_id", "text")
    index.add(docs.select((F.col("doc_id") * 2).alias("doc_id"), "text"))
    index.replace(docs.filter("doc_id % 2 = 0"))
    index.replace(docs, docs.select((F.col("doc_id") * 2).alias("doc_id")))
    index.compact()
    asked = t.benchmark.filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return index.search(asked, K).select("query_id", "doc_id", "score", F.col("place").cast("bigint").alias("place"))


def vector_index(t: Tables) -> Cells:
    return build(ranked_vectors(t), f"{shared_folder(t.spark)}/cells-{uuid.uuid4().hex}", keep=K)


@query()
def vector_index_topk(t: Tables) -> DataFrame:
    """The closest permitted vectors of each query in the cells around it: what `dense_topk_scoped` finds, but for a few that lie in other cells."""
    asked = vector_queries(t).withColumn("least_rank", F.lit(rank_of(PROFILES["work"])).cast("bigint"))
    found = vector_index(t).search(asked, K)
    return found.select("query_id", "id", "score", F.col("place").cast("bigint").alias("place"))


@query(f"""
WITH {VECTORS_SQL}, s AS (
  SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v JOIN v q ON q.id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)
SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reached FROM r WHERE place <= {K}
""")
def vector_index_recall(t: Tables) -> DataFrame:
    """Queries, their true neighbours, and whether the search by cells has nine tenths of these."""
    asked = vector_queries(t)
    true = nearest(ranked_vectors(t).drop("rank"), asked, K).select("query_id", "id")
    found = vector_index(t).search(asked, K).select("query_id", "id", F.lit(1).alias("hit"))
    both = true.join(found, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("reached"))


@query(f"""
WITH {VECTORS_SQL}, s AS (
  SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score
  FROM v JOIN v q ON q.id % 100 = 0 WHERE v.rank >= {rank_of('professional')}
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)
SELECT query_id, id, score, place::BIGINT AS place FROM r WHERE place <= {K} AND score >= {FIXTURE_THRESHOLD}
""")
def edited_vectors_topk(t: Tables) -> DataFrame:
    """`dense_topk_scoped` from an index whose ids first had the vectors of others, and then got their own while others went; all cells are probed, so the rows are exact."""
    own = ranked_vectors(t)
    others = own.withColumn("id", F.col("id") * 2)
    index = build(others, f"{shared_folder(t.spark)}/cells-{uuid.uuid4().hex}", keep=K)
    index.replace(own.filter("id % 2 = 0"))
    index.replace(own, others.select("id"))
    asked = vector_queries(t).withColumn("least_rank", F.lit(rank_of(PROFILES["work"])).cast("bigint"))
    found = index.search(asked, K, probes=len(index.centres)).filter(F.col("score") >= FIXTURE_THRESHOLD)
    return found.select("query_id", "id", "score", F.col("place").cast("bigint").alias("place"))


RARE = 8


@query(f"""
WITH {BM25_SQL}, {VECTORS_SQL}, rare AS (
  SELECT tf.doc_id AS query_id, term, row_number() OVER (PARTITION BY tf.doc_id ORDER BY df, term) AS p
  FROM tf JOIN df USING (term) WHERE tf.doc_id % 100 = 0 AND df >= 2
), ls AS (
  SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM rare JOIN gain USING (term) WHERE p <= {RARE} GROUP BY query_id, doc_id
), l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM ls),
ds AS (
  SELECT q.id AS query_id, v.id AS doc_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v JOIN v q ON q.id % 100 = 0
), d AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM ds),
votes AS (
  SELECT query_id, doc_id, 1e0 / (60 + place) AS vote FROM l WHERE place <= {POOL}
  UNION ALL SELECT query_id, doc_id, 1e0 / (60 + place) FROM d WHERE place <= {POOL}
), f AS (SELECT query_id, doc_id, round(sum(vote), 9) AS score FROM votes GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f)
SELECT query_id, doc_id, score, place::BIGINT AS place FROM r WHERE place <= {K}
""")
def hybrid_rrf(t: Tables) -> DataFrame:
    """Dense and lexical rankings fused; a document asks with its rarest words that others have too."""
    texts = t.documents.select("doc_id", "text")
    mine = texts.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    asked = written(rarest(document_counts(texts), mine, "query_id", RARE, at_least=2), "rare-words")
    lexical = bm25_where_lying(texts, asked, POOL)
    dense = nearest(ranked_vectors(t).drop("rank"), vector_queries(t), POOL).withColumnRenamed("id", "doc_id")
    fused = reciprocal_rank_fusion([lexical, dense], K)
    return fused.select("query_id", "doc_id", "score", F.col("place").cast("bigint").alias("place"))


HEAD_SQL = f"list_distinct(regexp_extract_all(lower(substr(text, 1, {SETTINGS.rerank_chars})), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""
WITH {VECTORS_SQL}, ds AS (
  SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS dense
  FROM v JOIN v q ON q.id % 100 = 0 WHERE v.id <> q.id AND v.rank >= {rank_of('professional')}
), d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS p FROM ds),
h AS (SELECT doc_id, source, {HEAD_SQL} AS words FROM documents),
x AS (
  SELECT query_id, d.id, dense, a.source = b.source AS own, len(list_intersect(a.words, b.words)) AS both_n, len(a.words) AS na, len(b.words) AS nb
  FROM d JOIN h a ON a.doc_id = query_id JOIN h b ON b.doc_id = d.id WHERE p <= {POOL}
), s AS (
  SELECT query_id, id, dense, round(both_n / nullif(na + nb - both_n, 0)::DOUBLE, 6) AS overlap, own FROM x
), f AS (
  SELECT *, round(coalesce(overlap, 0e0) + CASE WHEN own THEN {SETTINGS.boost}e0 ELSE 0e0 END, 6) AS final,
    CASE WHEN overlap >= {SETTINGS.rerank_high} THEN 'high' WHEN overlap < {SETTINGS.rerank_low} THEN 'low' ELSE 'middle' END AS band FROM s
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, dense DESC, id) AS place FROM f)
SELECT query_id, id, dense, overlap, final, band, place::BIGINT AS place FROM r WHERE place <= {K}
""")
def rerank_two_stage(t: Tables) -> DataFrame:
    """A pool by vectors, then the best by shared words of the texts' heads, own projects raised."""
    asked = vector_queries(t).withColumn("least_rank", F.lit(rank_of("professional")).cast("bigint"))
    pool = nearest(ranked_vectors(t), asked, POOL + 1).filter("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pool = pool.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= POOL).select("query_id", "id", F.col("score").alias("dense"))
    heads = t.documents.select("doc_id", "source", F.array_distinct(tokens(F.substring("text", 1, SETTINGS.rerank_chars))).alias("words"))
    a, b = (heads.select(F.col("doc_id").alias(key), F.col("source").alias(f"{p}_source"), F.col("words").alias(f"{p}_words")) for key, p in (("query_id", "a"), ("id", "b")))
    x = pool.join(a, "query_id").join(b, "id")
    both = F.size(F.array_intersect("a_words", "b_words"))
    overlap = F.round(both / F.nullif(F.size("a_words") + F.size("b_words") - both, F.lit(0)).cast("double"), 6)
    x = x.withColumn("overlap", overlap)
    boost = F.when(F.col("a_source") == F.col("b_source"), SETTINGS.boost).otherwise(0.0)
    x = x.withColumns({"final": F.round(F.coalesce("overlap", F.lit(0.0)) + boost, 6), "band": F.when(F.col("overlap") >= SETTINGS.rerank_high, "high").when(F.col("overlap") < SETTINGS.rerank_low, "low").otherwise("middle")})
    best = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("dense"), "id")
    return x.withColumn("place", F.row_number().over(best).cast("bigint")).filter(F.col("place") <= K).select("query_id", "id", "dense", "overlap", "final", "band", "place")


@query(f"""
WITH {VECTORS_SQL}, p AS (SELECT * FROM (VALUES ('full', {rank_of('private')}), ('work', {rank_of('professional')}), ('public', {rank_of('public')})) AS x(profile, least)),
s AS (
  SELECT profile, q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v JOIN v q ON q.id % 100 = 0 JOIN p ON v.rank >= least WHERE v.id <> q.id
), r AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY score DESC, id) AS place FROM s),
g AS (
  SELECT profile, query_id, max(score) AS best, count(*) FILTER (score >= {GATE_THRESHOLD}) AS hits FROM r WHERE place <= {K} GROUP BY profile, query_id
)
SELECT profile, query_id, hits > 0 AS inject, hits::BIGINT AS hits, best FROM g
""")
def gate_decision(t: Tables) -> DataFrame:
    """For each profile and query: inject or stay silent, number of hits, best score."""
    least = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(rank_of(c)).cast("bigint").alias("least_rank")) for p, c in PROFILES.items())))
    asked = vector_queries(t).withColumn("p", least).select("query_id", "vector", "p.profile", "p.least_rank")
    found = nearest(ranked_vectors(t), asked, K + 1).filter("id <> query_id")
    order = Window.partitionBy("profile", "query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= K)
    return gate(best, ["profile", "query_id"], GATE_THRESHOLD).select("profile", "query_id", "inject", "hits", "best")
