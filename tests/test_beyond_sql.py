"""Registered queries that SQL can't express, against brute force."""

import re

import numpy as np

from memoria.model import derived_scope, scope_rank
from memoria.plans import catalog
from pyspark.sql import functions as F
from test_communities import plain


def test_communities_of_the_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()
    links = [(f"page:{p}", f"target:{t}", 1.0) for p, html in pages for t in sorted(set(re.findall(r'href="([^"]+)"', html or "")))]
    placed, _ = plain(links)
    own = {p: placed.get(f"page:{p}", f"page:{p}") for p, _ in pages}
    least = {}
    for p, c in own.items():
        least[c] = min(p, least.get(c, p))
    got = {r.page_id: r.community for r in catalog.queries()["communities"](spark, small).collect()}
    assert got == {p: least[c] for p, c in own.items()}


def test_cells_find_most_true_neighbours(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", scope_rank(derived_scope(F.col("vec_id"))).alias("rank")).collect()
    ids, ranks = (np.array([r[c] for r in rows]) for c in ("vec_id", "rank"))
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        score = np.where(ranks >= 4, np.round(v @ v[q], 6), -9)
        want |= {(int(ids[q]), int(ids[k])) for k in np.lexsort((ids, -score))[:4]}
    got = {(r.query_id, r.id) for r in catalog.queries()["vector_index_topk"](spark, small).collect()}
    assert len(got & want) >= 0.75 * len(want) and {i for _, i in got} <= set(ids[ranks >= 4].tolist())


def test_drift_of_sketches_is_that_of_the_values(spark, small):
    rows = spark.read.parquet(f"{small}/events.parquet").select("event_type", (F.col("ts") < "2024-01-16").alias("early"), "value").toPandas()
    got = {r.event_type: r.drift for r in catalog.queries()["sketched_drift"](spark, small).collect()}
    for kind, own in rows.groupby("event_type"):
        a, b = own[own.early].value, own[~own.early].value
        at = np.arange(1, 10) / 10
        drift = np.max(np.abs(np.quantile(b, at) - np.quantile(a, at))) / (np.quantile(a, 0.95) - np.quantile(a, 0.05))
        assert abs(got[kind] - drift) < 0.08
