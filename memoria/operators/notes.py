"""Notes compiled from inbox files: one concept a note, with front matter, and the index over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoria.functions.text import first_given, front_matter, note_links, slug, trimmed, without_preamble
from memoria.operators.links import note_names

#: Characters of a first line that stands for a title.
TITLE_CHARS = 60


def field(front: Column, key: str) -> Column:
    """A field of front matter, without quotes; empty where it isn't there."""
    return F.regexp_replace(trimmed(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1)), "^[\"']|[\"']$", "")


def list_field(front: Column, key: str) -> Column:
    """A field of values in brackets or parted by commas."""
    values = F.split(F.regexp_replace(field(front, key), r"[\[\]]", ""), ",")
    return F.filter(F.transform(values, lambda v: F.regexp_replace(trimmed(v), "^[\"']|[\"']$", "")), lambda v: v != "")


def without_front(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n?", "")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, without heading marks, cut to TITLE_CHARS."""
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    return trimmed(F.substring(F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), "^#+ *", ""), 1, TITLE_CHARS))


def compiled(files: DataFrame) -> DataFrame:
    """Notes of files(path, domain, changed, sha, body): (path, name, title, aliases, domain, updated, provenance, links, note).

    What a file's own front matter says counts; else the title is its first line, or its path, and the domain is that given. Talk before the front matter goes. A note's name is the slug of
    its title with the beginning of its path's hash behind it, so that notes of one title don't meet. A null body is an empty one.
    """
    body = without_preamble(F.coalesce("body", F.lit("")))
    front = front_matter(F.col("_body"))
    text = without_front(F.col("_body"))
    df = files.withColumn("_body", body).withColumns({"_text": text, "title": first_given(field(front, "title"), first_line(text), F.col("path")), "aliases": list_field(front, "aliases"), "domain": first_given(field(front, "domain"), F.col("domain"), F.lit("general"))})
    df = df.withColumns({"name": F.concat_ws("-", F.nullif(slug(F.col("title")), F.lit("")), F.substring(F.md5(F.col("path").cast("binary")), 1, 8)), "provenance": F.concat_ws(" ", "path", "sha")})
    lines = [F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("aliases: ["), F.array_join("aliases", ", "), F.lit("]")), F.concat(F.lit("domain: "), "domain"),
             F.concat(F.lit("updated: "), F.coalesce(F.date_format("changed", "yyyy-MM-dd HH:mm:ss"), F.lit(""))), F.concat(F.lit("provenance: "), "provenance"), F.lit("---"), F.col("_text")]
    return df.select("path", "name", "title", "aliases", "domain", F.col("changed").alias("updated"), "provenance", note_links(F.col("_text")).alias("links"), F.concat_ws("\n", *lines).alias("note"))


def note_edges(notes: DataFrame) -> DataFrame:
    """(src, dst), each once: links between notes by title or alias, as names of notes; what names none is left out."""
    names = note_names(notes.select(F.col("name").alias("page_id"), "title", "aliases")).withColumnRenamed("name", "called")
    links = notes.select(F.col("name").alias("src"), F.explode("links").alias("link")).withColumn("called", slug(F.col("link")))
    return links.join(names, "called").select("src", "dst").filter("src <> dst").distinct()


def index_lines(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, line) of the index over all notes: totals, notes of each domain, links, orphans; one row a line, as there may be any number of notes."""
    line = lambda section, text: [F.lit(section).alias("section"), text.alias("line")]
    entities = notes.agg(F.count(F.lit(1)).alias("n")).select(*line("1 totals", F.format_string("total_entities: %d", "n")))
    relations = edges.agg(F.count(F.lit(1)).alias("n")).select(*line("1 totals", F.format_string("total_relations: %d", "n")))
    domains = notes.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(*line("2 namespaces", F.format_string("- %s: %d", "domain", "n")))
    graph = edges.select(*line("3 graph", F.format_string("- [[%s]] -> [[%s]]", "src", "dst")))
    linked = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    orphans = notes.join(linked, "name", "left_anti").select(*line("4 orphans", F.format_string("- [[%s]]", "name")))
    return entities.unionByName(relations).unionByName(domains).unionByName(graph).unionByName(orphans)


def entities(facts: DataFrame) -> DataFrame:
    """(entity, kind, roles, mentions) of facts(bucket, statement, evidence): people of the relationships, and themes; equal names in any case are one, named by the first in order."""
    named = facts.filter(F.col("bucket").isin("relationships", "intellectual_themes") & (trimmed(F.col("statement")) != ""))
    kind = F.when(F.col("bucket") == "relationships", "person").otherwise("theme")
    rows = named.select(trimmed(F.col("statement")).alias("name"), kind.alias("kind"), F.nullif(trimmed(F.col("evidence")), F.lit("")).alias("role"))
    # Roles are few words; of one entity they are counted once each before they come together.
    by_role = rows.groupBy(F.lower("name").alias("key"), "kind", "role").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    return by_role.groupBy("key", "kind").agg(F.min("name").alias("entity"), F.array_sort(F.collect_set("role")).alias("roles"), F.sum("n").alias("mentions")).select("entity", "kind", "roles", "mentions")
