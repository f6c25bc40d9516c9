"""The knowledge graph: links, backlinks, orphans, neighbourhoods, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria.functions.text import first_given
from memoria.operators import communities as modules
from memoria.operators.links import both_ways, edges, orphan_notes, resolved, spread_labels
from memoria.plans.registry import Tables, query
from memoria.tools import explore, related

E = "e AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"
#: Targets with more links are hubs, which every page shares.
HUB = 20


@query(f"WITH {E} SELECT page_id, target FROM e")
def page_edges(t: Tables) -> DataFrame:
    """Links of pages."""
    return edges(t.pages)


@query(f"WITH {E} SELECT target, count(*) AS n_pages, min(page_id) AS first_page, max(page_id) AS last_page FROM e GROUP BY target")
def backlinks(t: Tables) -> DataFrame:
    """For each target how many pages point to it, and the outermost of them."""
    return edges(t.pages).groupBy("target").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))


@query(f"WITH {E} SELECT target, min(page_id) AS page_id FROM e GROUP BY target HAVING count(*) = 1")
def orphans(t: Tables) -> DataFrame:
    """Targets that a single page links to."""
    return edges(t.pages).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id")).filter("n = 1").select("target", "page_id")


@query(f"WITH {E} SELECT p.page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.target = p.url) AND NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = p.page_id AND contains(e.target, '-'))")
def unlinked_pages(t: Tables) -> DataFrame:
    """Pages that no link names and that have no link with a dash: anti-joins against both ends."""
    e = edges(t.pages)
    named = t.pages.join(e.select(F.col("target").alias("url")).distinct(), "url", "left_anti")
    return named.join(e.filter(F.contains("target", F.lit("-"))), "page_id", "left_anti").select("page_id")


@query(f"""
WITH {E} SELECT (SELECT count(*) FROM pages) + (SELECT count(DISTINCT target) FROM e) AS entities, (SELECT count(*) FROM e) AS relations,
  (SELECT count(*) FROM (SELECT target FROM e GROUP BY target HAVING count(*) > {HUB})) AS hubs
""")
def graph_totals(t: Tables) -> DataFrame:
    """Entities, relations and hubs."""
    by_target = edges(t.pages).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    totals = by_target.agg(F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("relations"), F.count_if(F.col("n") > HUB).alias("hubs"))
    return totals.select((F.col("targets") + t.pages.count()).alias("entities"), "relations", "hubs")


def _spread_sql(rounds: int) -> str:
    out = "l0 AS (SELECT page_id, page_id AS label FROM pages)"
    for i in range(rounds):
        out += f""", t{i} AS (SELECT target, min(label) AS least FROM s JOIN l{i} USING (page_id) GROUP BY target),
        o{i} AS (SELECT page_id, min(least) AS least FROM s JOIN t{i} USING (target) GROUP BY page_id),
        l{i + 1} AS (SELECT page_id, least(label, coalesce(least, label)) AS label FROM l{i} LEFT JOIN o{i} USING (page_id))"""
    return out


@query()
def communities(t: Tables) -> DataFrame:
    """Pages and the community of each, by modularity over the links to their targets; a page without links is its own."""
    page, target = F.concat(F.lit("page:"), F.col("page_id").cast("string")), F.concat(F.lit("target:"), F.col("target"))
    placed, _ = modules.communities(edges(t.pages).select(page.alias("src"), target.alias("dst")))
    # Named by its smallest page, as its nodes' own names are none that a reader knows.
    own = t.pages.select("page_id", page.alias("node")).join(placed, "node", "left").select("page_id", F.coalesce("com", "node").alias("com"))
    names = own.groupBy("com").agg(F.min("page_id").alias("community"))
    return own.join(names, "com").select("page_id", "community")


@query(f"WITH {E} SELECT split_part(target, '/', 2) AS namespace, count(DISTINCT target) AS targets, count(*) AS links FROM e GROUP BY 1")
def link_namespaces(t: Tables) -> DataFrame:
    """Targets and links by the first part of the target."""
    return edges(t.pages).groupBy(F.split_part("target", F.lit("/"), F.lit(2)).alias("namespace")).agg(F.count_distinct("target").alias("targets"), F.count(F.lit(1)).alias("links"))


@query(f"""
WITH {E}, tt AS (SELECT DISTINCT a.target AS near, b.target FROM e a JOIN e b USING (page_id)), one AS (SELECT page_id AS src, target FROM e WHERE page_id % 100 = 0),
u AS (SELECT src, target, 1 AS hops FROM one UNION ALL SELECT o.src, tt.target, 2 FROM one o JOIN tt ON tt.near = o.target)
SELECT src, target, min(hops)::BIGINT AS hops FROM u GROUP BY src, target
""")
def khop2_targets(t: Tables) -> DataFrame:
    """Targets by which every hundredth page reaches others within two hops, hubs included: the pages are those of `page_edges` at them.

    Steps go from target to target by the pages that have both, so no pairs of pages are made.
    """
    e = edges(t.pages)
    steps = e.withColumnRenamed("target", "near").join(e, "page_id").select("near", "target").distinct()
    one = e.filter(F.col("page_id") % 100 == 0).select(F.col("page_id").alias("src"), "target")
    two = one.withColumnRenamed("target", "near").join(steps, "near").select("src", "target")
    hops = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))
    return hops.groupBy("src", "target").agg(F.min("hops").cast("bigint").alias("hops"))


ALL_STEPS = f"{E}, s AS (SELECT target, page_id FROM e)"


@query(f"WITH {ALL_STEPS}, {_spread_sql(3)} SELECT page_id, label FROM l3")
def label_propagation_all(t: Tables) -> DataFrame:
    """Communities by three rounds of spreading the least label, hubs included."""
    return spread_labels(edges(t.pages), t.pages, 3)


@query(f"WITH {ALL_STEPS}, {_spread_sql(3)} SELECT label, count(*) AS n_pages FROM l3 GROUP BY label HAVING count(*) > 1")
def community_sizes_all(t: Tables) -> DataFrame:
    """Communities of more than one page, hubs included."""
    return label_propagation_all(t).groupBy("label").agg(F.count(F.lit(1)).alias("n_pages")).filter("n_pages > 1")


def notes(t: Tables) -> DataFrame:
    """Pages as notes: their titles, and the title's first and last words as aliases."""
    title = first_given(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("none"))
    words = F.split(title, " ")
    return t.pages.select("page_id", title.alias("title"), F.array(F.element_at(words, 1), F.element_at(words, -1)).alias("aliases"))


def note_links(t: Tables) -> DataFrame:
    return resolved(edges(t.pages), notes(t))


def _slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


RESOLVED = f"""{E}, n AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') AS title FROM pages),
names AS (
  SELECT page_id, 0 AS rank, {_slug_sql("title")} AS name FROM n UNION ALL SELECT page_id, 1, {_slug_sql("string_split(title, ' ')[1]")} FROM n
  UNION ALL SELECT page_id, 1, {_slug_sql("string_split(title, ' ')[-1]")} FROM n
), named AS (SELECT name, min((rank, page_id)) AS m FROM names WHERE name <> '' GROUP BY name),
l AS (SELECT e.page_id, e.target, m[2] AS dst, m[1] = 0 AS by_title FROM e LEFT JOIN named ON name = {_slug_sql("target")}),
k AS (SELECT page_id, dst FROM l WHERE dst IS NOT NULL AND dst <> page_id),
w AS (SELECT page_id, other, sum(o)::BIGINT AS n_out, sum(b)::BIGINT AS n_back FROM (
  SELECT page_id, dst AS other, 1 AS o, 0 AS b FROM k UNION ALL SELECT dst, page_id, 0, 1 FROM k) GROUP BY page_id, other)"""


@query(f"WITH {RESOLVED} SELECT page_id, target, dst, by_title FROM l")
def resolved_links(t: Tables) -> DataFrame:
    """Links with the note that each names by title or alias; null where none does."""
    return note_links(t)


@query(f"WITH {RESOLVED} SELECT page_id, other, n_out, n_back FROM w")
def note_backlinks(t: Tables) -> DataFrame:
    """Notes that a link joins, seen from either end."""
    return both_ways(note_links(t))


@query(f"WITH {RESOLVED} SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM w)")
def note_orphans(t: Tables) -> DataFrame:
    """Notes that no link joins to another."""
    return orphan_notes(note_links(t), t.pages)


@query(f"WITH {RESOLVED} SELECT x.page_id, count(*) AS links FROM (SELECT dst AS page_id FROM k WHERE page_id = 0 UNION ALL SELECT page_id FROM k WHERE dst = 0) x GROUP BY x.page_id")
def tool_related(t: Tables) -> DataFrame:
    """Notes beside the first note."""
    return related(note_links(t), 0)


@query(f"""
WITH {RESOLVED}, s AS (SELECT page_id AS start FROM pages WHERE page_id % 100 = 0),
h1 AS (SELECT DISTINCT start, other AS page_id FROM s JOIN w ON w.page_id = start WHERE other <> start),
h2 AS (SELECT DISTINCT start, other AS page_id FROM h1 JOIN w USING (page_id) WHERE other <> start AND (start, other) NOT IN (SELECT start, page_id FROM h1))
SELECT start, page_id, 1::BIGINT AS hops FROM h1 UNION ALL SELECT start, page_id, 2 FROM h2
""")
def tool_explore(t: Tables) -> DataFrame:
    """Notes within two links of every hundredth note, hubs included."""
    found = note_links(t).filter("dst is not null and dst <> page_id")
    return explore(found, t.pages.filter(F.col("page_id") % 100 == 0).select(F.col("page_id").alias("start")), 2)


@query(f"WITH {RESOLVED} SELECT split_part(split_part(url, '://', 2), '/', 2) AS domain, count(*) AS notes, count(o.page_id) AS orphans, coalesce(sum(d), 0)::BIGINT AS links, max(title) AS last_title FROM pages JOIN n USING (page_id) LEFT JOIN (SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM w)) o USING (page_id) LEFT JOIN (SELECT page_id, sum(n_out) AS d FROM w GROUP BY page_id) x USING (page_id) GROUP BY 1")
def master_index(t: Tables) -> DataFrame:
    """The master index: notes, links and orphans by domain."""
    links = note_links(t)
    lone = orphan_notes(links, t.pages).withColumn("lone", F.lit(True))
    out = both_ways(links).groupBy("page_id").agg(F.sum("n_out").alias("d"))
    domain = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2))
    df = t.pages.select("page_id", domain.alias("domain")).join(notes(t).select("page_id", "title"), "page_id").join(lone, "page_id", "left").join(out, "page_id", "left")
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("notes"), F.count("lone").alias("orphans"), F.coalesce(F.sum("d"), F.lit(0)).alias("links"), F.max("title").alias("last_title"))
