"""The tools as SQL table functions over registered views, for sessions that speak SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memoria.model import PROFILES, SCOPES
from memoria.operators.lexical import B, K1, Terms

#: Views: memory_items(doc_id, source, n_chars), memory_events(user_id, event_id, ts), memory_links(page_id, dst), memory_terms(doc_id, rank, length, term, tf).
_rank = " ".join(f"WHEN '{name}' THEN {SCOPES.index(ceiling) + 1}" for name, ceiling in PROFILES.items())

#: Name, parameters, columns, body. A null bound is none.
FUNCTIONS = [
    (
        "timeline", "first_moment TIMESTAMP_NTZ, end_moment TIMESTAMP_NTZ", "user_id BIGINT, event_id BIGINT, ts TIMESTAMP_NTZ, gap_minutes BIGINT",
        """SELECT user_id, event_id, ts, CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60000000) AS BIGINT)
        FROM memory_events WHERE (first_moment IS NULL OR ts >= first_moment) AND (end_moment IS NULL OR ts < end_moment)""",
    ),
    (
        "project_state", "wanted STRING", "project STRING, items BIGINT, chars BIGINT, newest BIGINT",
        "SELECT source, count(*), sum(n_chars), max(doc_id) FROM memory_items WHERE wanted IS NULL OR source = wanted GROUP BY source",
    ),
    (
        "related", "note BIGINT", "page_id BIGINT, links BIGINT",
        """SELECT other, count(*) FROM (SELECT dst AS other FROM memory_links WHERE memory_links.page_id = note UNION ALL SELECT memory_links.page_id FROM memory_links WHERE dst = note)
        WHERE other <> note GROUP BY other""",
    ),
    (
        "search_memory", "prompt STRING, profile STRING, k INT", "doc_id BIGINT, score DOUBLE, place BIGINT",
        f"""WITH asked AS (SELECT DISTINCT explode(regexp_extract_all(lower(prompt), '[\\\\p{{L}}\\\\p{{N}}]+', 0)) AS term),
        own AS (SELECT t.* FROM memory_terms t LEFT SEMI JOIN asked ON t.term = asked.term),
        df AS (SELECT term, count(*) AS df FROM own GROUP BY term),
        scored AS (
          SELECT own.doc_id, round(sum(ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * {K1 + 1}D / (tf + {K1}D * (1 - {B}D + {B}D * length / mean_length))), 6) AS score
          FROM own JOIN df ON own.term = df.term CROSS JOIN memory_totals WHERE rank >= CASE profile {_rank} ELSE {len(SCOPES) + 1} END GROUP BY own.doc_id),
        placed AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS place FROM scored)
        SELECT placed.doc_id, placed.score, placed.place FROM placed WHERE placed.place <= k""",
    ),
]


def register(spark: SparkSession, items: DataFrame | None = None, events: DataFrame | None = None, links: DataFrame | None = None, terms: Terms | None = None) -> list[str]:
    """Registers views of what is given and the functions over them, and tells their names.

    `memory_totals`, which the search crosses its rows with, is a single row.
    """
    given = {"memory_items": items, "memory_events": events, "memory_links": links, "memory_terms": terms.rows if terms else None}
    for name, df in given.items():
        if df is not None:
            df.createOrReplaceTempView(name)
    if terms:
        spark.createDataFrame([(terms.n, terms.mean_length)], "n bigint, mean_length double").createOrReplaceTempView("memory_totals")
    needs = {"timeline": events, "project_state": items, "related": links, "search_memory": terms}
    made = [f for f in FUNCTIONS if needs[f[0]] is not None]
    for name, parameters, columns, body in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [f[0] for f in made]
