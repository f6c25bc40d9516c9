"""The tools of a session over the given tables, with fixed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria import sql, tools
from memoria.model import RANK_SQL, SCOPE_SQL, SETTINGS, derived_scope, scope_rank
from memoria.operators.lexical import Terms
from memoria.plans.registry import Tables, query
from memoria.plans.retrieval import BM25_SQL
from memoria.plans.text import LEXICON

PROMPT = "the and thes whan"
K = SETTINGS.top_k


def items(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", derived_scope(F.col("doc_id")).alias("scope"))


_words = ", ".join(f"('{w}')" for w in PROMPT.split())
SEARCH_SQL = f"""{BM25_SQL}, q(term) AS (VALUES {_words}), ranks AS (SELECT doc_id, {RANK_SQL.format(SCOPE_SQL)} AS rank FROM documents),
s AS (SELECT doc_id, round(sum(gain), 6) AS score FROM q JOIN gain USING (term) JOIN ranks USING (doc_id) WHERE rank >= 4 GROUP BY doc_id),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s)"""


@query(f"WITH {SEARCH_SQL} SELECT doc_id, score, place::BIGINT AS place FROM r WHERE place <= {K}")
def tool_search_memory(t: Tables) -> DataFrame:
    """The best permitted documents for a prompt."""
    return tools.search_memory(items(t), PROMPT, "work")


@query(f"WITH {SEARCH_SQL} SELECT count(*) FILTER (score >= 0.5) > 0 AS inject, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY place) FILTER (score >= 0.5), '') AS hits FROM r WHERE place <= {K}")
def tool_gate(t: Tables) -> DataFrame:
    """Whether a prompt gets memories, and which."""
    return tools.gate_prompt(items(t), PROMPT, 0.5).select("inject", F.array_join(F.transform("hits", lambda h: h.cast("string")), ",").alias("hits"))


@query("SELECT 'documents' AS \"table\", count(*) AS n, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'embeddings', count(*), count(*) > 0 FROM embeddings")
def tool_health(t: Tables) -> DataFrame:
    """Rows of the store's tables."""
    return tools.health({"documents": t.documents, "embeddings": t.embeddings})


@query(f"""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS p FROM documents WHERE source = 'src1')
SELECT d.source AS project, count(*) AS items, sum(n_chars)::BIGINT AS chars, any_value(latest) AS latest FROM documents d
JOIN (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY p) AS latest FROM r WHERE p <= {K} GROUP BY source) x ON x.source = d.source GROUP BY d.source
""")
def tool_project_state(t: Tables) -> DataFrame:
    """Size and newest items of one project."""
    state = tools.project_state(t.documents, "src1")
    return state.withColumn("latest", F.array_join(F.transform("latest", lambda x: x.cast("string")), ","))


@query("""
WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12')
SELECT user_id, event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 60000000 AS gap_minutes FROM e
""")
def tool_timeline(t: Tables) -> DataFrame:
    """Events of two days with the gaps between them."""
    return tools.timeline(t.events, "2024-01-10", "2024-01-12").select("user_id", "event_id", "ts", "gap_minutes")


@query("""
WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12')
SELECT user_id, event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 60000000 AS gap_minutes FROM e
""")
def sql_timeline(t: Tables) -> DataFrame:
    """The timeline as a table function of SQL."""
    sql.register(t.spark, events=t.events)
    return t.spark.sql("SELECT * FROM timeline(TIMESTAMP_NTZ '2024-01-10', TIMESTAMP_NTZ '2024-01-12')")


@query(f"WITH {SEARCH_SQL} SELECT doc_id, score, place::BIGINT AS place FROM r WHERE place <= {K}")
def sql_search_memory(t: Tables) -> DataFrame:
    """The search as a table function of SQL."""
    sql.register(t.spark, terms=Terms(items(t).select("doc_id", "text", scope_rank(F.col("scope")).alias("rank"))))
    return t.spark.sql(f"SELECT * FROM search_memory('{PROMPT}', 'work', {K})")


FACETS_SQL = "f AS (SELECT doc_id AS facet_id, source AS bucket, split_part(text, '.', 1) AS statement, n_chars AS weight FROM documents)"
OPEN_SQL = f"bucket <> 'src3' AND NOT regexp_matches(lower(statement), '{'|'.join(LEXICON)}')"


def facets(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("facet_id"), F.col("source").alias("bucket"), F.split_part("text", F.lit("."), F.lit(1)).alias("statement"), F.col("n_chars").alias("weight"))


@query(f"""
WITH {FACETS_SQL}, o AS (SELECT DISTINCT bucket, statement, weight FROM f WHERE {OPEN_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY weight DESC, statement) AS p FROM o)
SELECT bucket, md5(string_agg(statement, '|' ORDER BY p)) AS statements_md5, count(*) AS n FROM r WHERE p <= {K} GROUP BY bucket
""")
def tool_user_profile(t: Tables) -> DataFrame:
    """The heaviest open statements of each bucket."""
    own = tools.user_profile(facets(t), quarantined=["src3"], words=LEXICON)
    return own.select("bucket", F.md5(F.array_join("statements", "|").cast("binary")).alias("statements_md5"), F.size("statements").cast("bigint").alias("n"))


_persona_sql = BM25_SQL.replace("FROM documents)", "FROM o)").replace("doc_id, unnest(regexp_extract_all(lower(text)", "facet_id AS doc_id, unnest(regexp_extract_all(lower(statement)")


@query(f"""
WITH {FACETS_SQL}, o AS (SELECT * FROM f WHERE {OPEN_SQL}), {_persona_sql}, q(term) AS (VALUES {_words}),
s AS (SELECT doc_id, round(sum(gain), 6) AS score FROM q JOIN gain USING (term) GROUP BY doc_id), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s)
SELECT doc_id AS facet_id, score, place::BIGINT AS place FROM r WHERE place <= {K}
""")
def tool_recall_persona(t: Tables) -> DataFrame:
    """Open statements for a prompt."""
    return tools.recall_persona(facets(t), PROMPT, quarantined=["src3"], words=LEXICON)
