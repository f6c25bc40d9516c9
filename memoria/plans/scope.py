"""The audience ceiling: who may see what, and proof that nothing leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoria.functions.text import tokens
from memoria.model import PROFILES, PROFILES_SQL, RANK_SQL, SCOPE_SQL, SCOPES, SETTINGS, admits, derived_scope, scope_rank
from memoria.operators.lexical import Terms, bm25
from memoria.operators.pins import pinned
from memoria.plans.registry import Tables, query
from memoria.plans.retrieval import BM25_SQL

CLASSES = ["direct", "indirect", "inference", "clinical"]


def scoped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", derived_scope(F.col("doc_id")).alias("scope"))


def leak_counts(t: Tables, filtered: bool) -> DataFrame:
    """Items injected for each profile and source, and those below the ceiling, counted by rank."""
    each = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).alias("ceiling")) for p, c in PROFILES.items()))
    pairs = scoped(t).select("source", "scope", F.inline(each))
    if filtered:
        pairs = pairs.filter(admits(F.col("scope"), F.col("ceiling")))
    below = scope_rank(F.col("scope")) < scope_rank(F.col("ceiling"))
    return pairs.groupBy("profile", "source").agg(F.count(F.lit(1)).alias("injected"), F.count_if(below).alias("leaks"))


LEAKS_SQL = """
WITH d AS (SELECT source, {scope} AS scope FROM documents), x AS (
  SELECT profile, source, {rank_s} AS s, {rank_c} AS c FROM d, {profiles}
)
SELECT profile, source, count(*) AS injected, count(*) FILTER (s < c) AS leaks FROM x {where} GROUP BY profile, source
"""
_parts = {"scope": SCOPE_SQL, "rank_s": RANK_SQL.format("scope"), "rank_c": RANK_SQL.format("ceiling"), "profiles": PROFILES_SQL}


@query(LEAKS_SQL.format(where="WHERE s >= c", **_parts))
def scope_leaks_by_profile(t: Tables) -> DataFrame:
    """Items that each profile may see, by source; `probe_leaks` is the evaluation over what retrieval returns."""
    return leak_counts(t, filtered=True)


@query(LEAKS_SQL.format(where="", **_parts))
def scope_leaks_without_ceiling(t: Tables) -> DataFrame:
    """The same count over a plan without the ceiling finds leaks."""
    return leak_counts(t, filtered=False)


@query(f"""
WITH p AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'work' ELSE 'public' END AS profile,
  CASE item_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' WHEN 2 THEN 'inference' ELSE 'clinical' END AS class, text FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY profile, class ORDER BY item_id) AS n FROM p)
SELECT profile, class, item_id, md5(text) AS prompt_md5 FROM r WHERE n = 1
""")
def probe_smoke_subset(t: Tables) -> DataFrame:
    """One probe for each boundary and class."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") % len(names) + 1).cast("int"))
    probes = t.benchmark.select("item_id", pick(["full", "work", "public"]).alias("profile"), pick(CLASSES).alias("class"), "text")
    first = probes.groupBy("profile", "class").agg(F.min_by(F.struct("item_id", "text"), "item_id").alias("x"))
    return first.select("profile", "class", "x.item_id", F.md5(F.col("x.text").cast("binary")).alias("prompt_md5"))


@query(f"""
WITH d AS (SELECT doc_id, lang, {SCOPE_SQL} AS scope FROM documents),
r AS (SELECT doc_id, scope, {RANK_SQL.format('scope')} AS rank, CASE WHEN lang = 'en' THEN 5 WHEN lang = 'de' THEN 3 ELSE 2 END AS floor_rank FROM d)
SELECT doc_id, scope, CASE least(rank, floor_rank) WHEN 1 THEN 'clinical' WHEN 2 THEN 'private' WHEN 3 THEN 'personal' WHEN 4 THEN 'professional' ELSE 'public' END AS floored FROM r
""")
def scope_floors(t: Tables) -> DataFrame:
    """Items made at least as restricted as their group's floor asks."""
    d = t.documents.select("doc_id", "lang", derived_scope(F.col("doc_id")).alias("scope"))
    floor = F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).otherwise(2)
    return d.select("doc_id", "scope", F.element_at(F.array(*map(F.lit, SCOPES)), F.least(scope_rank(F.col("scope")), floor).cast("int")).alias("floored"))


PINS = [("/", "full"), ("/en", "work"), ("/en/1", "public"), ("/fr", "work")]


@query(f"""
WITH p AS (SELECT page_id, '/' || split_part(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/', 2) || CASE WHEN split_part(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/', 3) <> '' THEN '/' || split_part(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/', 3) ELSE '' END AS path FROM pages),
pins(pin, profile) AS (VALUES {", ".join(map(str, PINS))})
SELECT page_id, path, (SELECT arg_max(profile, length(pin)) FROM pins WHERE pin = '/' OR path = pin OR starts_with(path, pin || '/')) AS profile FROM p
""")
def profile_by_path(t: Tables) -> DataFrame:
    """The profile that a working path is pinned to: the longest pin that is the path or a folder above it."""
    parts = F.split(F.split_part(F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/")
    third = F.coalesce(F.get(parts, 2), F.lit(""))
    path = F.concat(F.lit("/"), F.coalesce(F.get(parts, 1), F.lit("")), F.when(third != "", F.concat(F.lit("/"), third)).otherwise(""))
    pins = t.spark.createDataFrame(PINS, "pin string, profile string")
    return pinned(t.pages.select("page_id", path.alias("path")), pins).select("page_id", "path", "profile")


@query("""
WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_name END AS name, CASE c_nationkey % 6 WHEN 0 THEN 'clinical' WHEN 1 THEN 'private' WHEN 2 THEN 'personal' WHEN 3 THEN 'professional' WHEN 4 THEN 'public' ELSE lower(c_mktsegment) END AS ceiling FROM customer)
SELECT id, name, ceiling FROM r WHERE name IS NULL OR ceiling NOT IN ('clinical', 'private', 'personal', 'professional', 'public')
""")
def registry_invalid(t: Tables) -> DataFrame:
    """Registry rows without a name or with an unknown ceiling."""
    names = F.array(*map(F.lit, SCOPES))
    ceiling = F.coalesce(F.get(names, (F.col("c_nationkey") % 6).cast("int")), F.lower("c_mktsegment"))
    r = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 97 != 0, F.col("c_name")).alias("name"), ceiling.alias("ceiling"))
    return r.filter(F.col("name").isNull() | ~F.col("ceiling").isin(SCOPES))


@query(f"""
SELECT source, count(*) FILTER (l.toxic = 1) AS marked, count(*) AS items FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
WHERE source IN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0) GROUP BY source
""")
def personal_projects(t: Tables) -> DataFrame:
    """Projects marked by a semi-join: those with a low-quality item, with their marked items."""
    labels = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    low = t.documents.join(labels.filter("quality = 0"), "doc_id", "left_semi").select("source").distinct()
    own = t.documents.select("doc_id", "source").join(low, "source", "left_semi").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return own.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("marked"), F.count(F.lit(1)).alias("items"))


#: Words of a probe that are asked for: the rarest.
PROBE_TERMS = 8


def _ceilings() -> Column:
    return F.create_map(*[F.lit(x) for p, c in PROFILES.items() for x in (p, SCOPES.index(c) + 1)])


def probes(t: Tables) -> DataFrame:
    """Benchmark items as probes of a boundary and a class each."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") % len(names) + 1).cast("int"))
    own = t.benchmark.select("item_id", pick(["full", "work", "public"]).alias("profile"), pick(CLASSES).alias("class"), "text")
    return own.withColumn("ceiling", F.element_at(_ceilings(), F.col("profile")))


def probe_results(t: Tables, with_ceiling: bool) -> DataFrame:
    """(profile, class, probes, injected, leaks): what retrieval returns for each probe, and how much of it ranks below the profile's ceiling."""
    words = probes(t).select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    terms = Terms(t.documents.select("doc_id", "text", scope_rank(derived_scope(F.col("doc_id"))).alias("rank")), asked=words)
    asked = terms.rarest(words, "query_id", PROBE_TERMS)
    own = probes(t).select(F.col("item_id").alias("query_id"), "profile", "class", "ceiling")
    if with_ceiling:
        asked = asked.join(own.select("query_id", F.col("ceiling").alias("least_rank")), "query_id")
    found = own.join(bm25(terms, asked, SETTINGS.top_k), "query_id", "left")
    return found.groupBy("profile", "class").agg(F.count_distinct("query_id").alias("probes"), F.count("doc_id").alias("injected"), F.count_if(F.col("rank") < F.col("ceiling")).alias("leaks"))


PROBE_SQL = f"""
WITH {BM25_SQL}, p AS (
  SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'work' ELSE 'public' END AS profile, CASE item_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END AS ceiling,
    CASE item_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' WHEN 2 THEN 'inference' ELSE 'clinical' END AS class FROM benchmark
), pt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM p),
rare AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS n FROM pt JOIN df USING (term)),
ranks AS (SELECT doc_id, {RANK_SQL.format(SCOPE_SQL)} AS rank FROM documents),
s AS (SELECT item_id, doc_id, rank, round(sum(gain), 6) AS score FROM rare JOIN gain USING (term) JOIN ranks USING (doc_id) JOIN p USING (item_id) WHERE n <= {PROBE_TERMS} /*where*/ GROUP BY item_id, doc_id, rank),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT profile, class, count(DISTINCT p.item_id) AS probes, count(doc_id) AS injected, count(*) FILTER (rank < ceiling) AS leaks
FROM p LEFT JOIN (SELECT * FROM r WHERE place <= {SETTINGS.top_k}) x ON x.item_id = p.item_id GROUP BY profile, class
"""


@query(PROBE_SQL.replace("/*where*/", "AND rank >= ceiling"))
def probe_leaks(t: Tables) -> DataFrame:
    """What retrieval injects for each probe, and leaks, by boundary and class: none with the ceiling in place."""
    return probe_results(t, with_ceiling=True)


@query(PROBE_SQL)
def probe_leaks_without_ceiling(t: Tables) -> DataFrame:
    """The same probes over retrieval without the ceiling, which leaks."""
    return probe_results(t, with_ceiling=False)
