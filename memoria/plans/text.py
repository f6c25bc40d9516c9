"""Text functions over whole tables: scrubbing, dates, slugs, chunks, clinical routing, falsy chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria.functions import text as tx
from memoria.functions.text import first_given, loose_date, scrubbed, slug, tokens
from memoria.operators import notes
from memoria.plans.registry import Tables, query

#: Words of the given tables that stand for the clinical lexicon.
LEXICON = ["worthless", "pathetic", "disgusting"]


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{"|".join(LEXICON)}') OR source = 'src3' THEN 'clinical' ELSE source END AS bucket FROM documents
""")
def clinical_reroute(t: Tables) -> DataFrame:
    """A clinical statement leaves its bucket; one bucket is quarantined as a whole."""
    forced = tx.is_clinical(F.col("text"), LEXICON) | (F.col("source") == "src3")
    return t.documents.select("doc_id", F.when(forced, "clinical").otherwise(F.col("source")).alias("bucket"))


@query(rf"""
SELECT doc_id, md5(s) AS scrubbed_md5, len(regexp_extract_all(s, '\[email\]'))::BIGINT AS emails, len(regexp_extract_all(s, '\[phone\]'))::BIGINT AS phones
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{tx.PLAIN_EMAIL}', '[email]', 'g'), '{tx.PHONE}', '[phone]', 'g') AS s FROM documents)
""")
def contact_scrub(t: Tables) -> DataFrame:
    """E-mail addresses and phone numbers taken out of statements."""
    s = t.documents.select("doc_id", scrubbed(F.col("text")).alias("s"))
    count = lambda mark: F.regexp_count("s", F.lit(mark)).cast("bigint")
    return s.select("doc_id", F.md5(F.col("s").cast("binary")).alias("scrubbed_md5"), count(r"\[email\]").alias("emails"), count(r"\[phone\]").alias("phones"))


@query(r"""
WITH f AS (SELECT event_id, regexp_extract(raw, '(19[0-9]{2}|20[0-9]{2})(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?', 0) AS found, raw FROM (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'in ' || (1970 + event_id % 131) || ', born' WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m') WHEN event_id % 4 = 2 THEN 'in ' || strftime(ts, '%Y') || ', maybe' ELSE event_type END AS raw FROM events))
SELECT event_id, raw, CASE WHEN day BETWEEN DATE '1990-01-01' AND current_date THEN day END AS day FROM (
  SELECT event_id, raw, try_cast(CASE length(found) WHEN 4 THEN found || '-01-01' WHEN 7 THEN found || '-01' WHEN 10 THEN found END AS DATE) AS day FROM f)
""")
def loose_dates(t: Tables) -> DataFrame:
    """Dates of varying precision, as people write them, from 1990 to today, parsed or null."""
    k = F.col("event_id") % 4
    far = F.concat(F.lit("in "), (1970 + F.col("event_id") % 131).cast("string"), F.lit(", born"))
    raw = (
        F.when(F.col("event_id") % 97 == 0, far)
        .when(k == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("ts", "yyyy-MM"))
        .when(k == 2, F.concat(F.lit("in "), F.date_format("ts", "yyyy"), F.lit(", maybe")))
        .otherwise(F.col("event_type"))
    )
    return t.events.select("event_id", raw.alias("raw")).withColumn("day", loose_date(F.col("raw")))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  lower(regexp_extract(url, '\.([a-z]+)$', 1)) AS suffix, contains(url, '?') AS has_query, rpad(split_part(url, '://', 1), 8, '.') AS padded FROM pages
""")
def slugs(t: Tables) -> DataFrame:
    """Slug, suffix and simple tests of each url."""
    return t.pages.select(
        "page_id", slug(F.col("url")).alias("slug"), F.lower(F.regexp_extract("url", r"\.([a-z]+)$", 1)).alias("suffix"),
        F.contains("url", F.lit("?")).alias("has_query"), F.rpad(F.split_part("url", F.lit("://"), F.lit(1)), 8, ".").alias("padded"),
    )


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
c AS (SELECT doc_id, (i - 1) // 180 AS chunk, list_slice(words, i, i + 199) AS part FROM w, unnest(range(1, greatest(len(words), 1) + 1, 180)) AS r(i))
SELECT doc_id, chunk::BIGINT AS chunk, len(part)::BIGINT AS n_words, md5(array_to_string(part, ' ')) AS chunk_md5 FROM c
""")
def document_chunks(t: Tables) -> DataFrame:
    """Chunks of 200 words that overlap by 20, content-addressed."""
    parts = t.documents.select("doc_id", F.posexplode(tx.chunks(tokens(F.col("text")), 200, 180)).alias("chunk", "part"))
    return parts.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.size("part").cast("bigint").alias("n_words"), F.md5(F.array_join("part", " ").cast("binary")).alias("chunk_md5"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
b AS (SELECT doc_id, i FROM w, unnest(range(4, len(words) + 1)) AS r(i) WHERE starts_with(md5(array_to_string(words[i - 3:i], ' ')), '00') UNION SELECT doc_id, len(words) FROM w),
g AS (SELECT doc_id, i, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM b),
c AS (SELECT doc_id, s, least(s + 1024, i) AS e FROM g, unnest(range(a, i, 1024)) AS r(s)),
k AS (SELECT doc_id, s, sha256(array_to_string(words[s + 1:e], ' ')) AS chunk_sha, e - s AS n_words FROM c JOIN w USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk, n_words, chunk_sha FROM k
""")
def content_chunks(t: Tables) -> DataFrame:
    """Chunks cut where the words say so, content-addressed: a changed document has most of its keys as before."""
    parts = t.documents.select("doc_id", F.posexplode(tx.content_chunks(tokens(F.col("text")))).alias("chunk", "part"))
    return parts.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.size("part").cast("bigint").alias("n_words"), F.sha2(F.array_join("part", " "), 256).alias("chunk_sha"))


@query(r"""
WITH w AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
c AS (SELECT doc_id, source, lang, (i - 1) // 180 AS chunk, list_slice(words, i, i + 199) AS part FROM w, unnest(range(1, greatest(len(words), 1) + 1, 180)) AS r(i))
SELECT doc_id, chunk::BIGINT AS chunk, sha256(source || ' / ' || lang || ': ' || array_to_string(part, ' ')) AS contextual_sha FROM c
""")
def contextual_chunk_keys_all(t: Tables) -> DataFrame:
    """The address of every chunk that `document_chunks` makes, with its document's project and language in front."""
    parts = t.documents.select("doc_id", "source", "lang", F.posexplode(tx.chunks(tokens(F.col("text")), 200, 180)).alias("chunk", "part"))
    keyed = F.sha2(F.concat("source", F.lit(" / "), "lang", F.lit(": "), F.array_join("part", " ")), 256)
    return parts.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), keyed.alias("contextual_sha"))


@query("""
WITH x AS (SELECT event_id, event_type, value, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS given, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, coalesce(nullif(given, ''), 'unnamed') AS or_name, coalesce(given, 'unnamed') AS nullish_name, coalesce(k > 50, true) <> false AS enabled,
  nullif(k, 0) AS or_k, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS side, given IN ('click', 'view') AS is_seen FROM x
""")
def falsy_chains(t: Tables) -> DataFrame:
    """Defaults for missing values: by falsiness (empty counts as missing) and by null alone."""
    e = F.col("event_id")
    given = F.when(e % 5 == 0, "").when(e % 7 == 0, None).otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    x = t.events.select("event_id", "value", given.alias("given"), k.alias("k"))
    return x.select(
        "event_id", first_given(F.col("given"), F.lit("unnamed")).alias("or_name"), F.coalesce("given", F.lit("unnamed")).alias("nullish_name"),
        (F.coalesce(F.col("k") > 50, F.lit(True)) != F.lit(False)).alias("enabled"), F.nullif("k", F.lit(0)).alias("or_k"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("side"), F.col("given").isin("click", "view").alias("is_seen"),
    )


@query(r"""
WITH x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS lines, regexp_split_to_array(trim(text), '\s+') AS words, text FROM documents)
SELECT doc_id, len(lines)::BIGINT AS n_lines, words[-1] AS last_word, len(list_distinct(lines)) = len(lines) AS all_lines_differ,
  array_to_string(list_transform(lines, lambda s: substr(s, 1, 3)), '|') AS heads, len(list_filter(lines, lambda s: length(s) > 200)) > 0 AS some_long, regexp_matches(text, '[0-9]') AS has_digit FROM x
""")
def line_functions(t: Tables) -> DataFrame:
    """Lines and words of each document by map, filter, some, every, find, join."""
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    x = t.documents.select("doc_id", "text", lines.alias("lines"), F.split(F.trim("text"), r"\s+").alias("words"))
    return x.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.element_at("words", -1).alias("last_word"),
        (F.size(F.array_distinct("lines")) == F.size("lines")).alias("all_lines_differ"),
        F.array_join(F.transform("lines", lambda s: F.substring(s, 1, 3)), "|").alias("heads"),
        F.exists("lines", lambda s: F.length(s) > 200).alias("some_long"), F.col("text").rlike("[0-9]").alias("has_digit"),
    )


@query("""
SELECT doc_id, bucket, statement_md5, evidence FROM (
  SELECT doc_id, 'biography' AS bucket, md5(split_part(text, '.', 1)) AS statement_md5, source AS evidence FROM documents
  UNION ALL SELECT doc_id, 'voice_style', md5(substr(text, 1, 40)), lang FROM documents
  UNION ALL SELECT d.doc_id, 'decision_patterns', md5('quality ' || quality), 'toxic ' || toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
""")
def facets_long(t: Tables) -> DataFrame:
    """Facet buckets turned from columns to rows by one pass over documents, and facets of their labels."""
    md5 = lambda c: F.md5(c.cast("binary"))
    facet = lambda bucket, statement, evidence: F.struct(F.lit(bucket).alias("bucket"), md5(statement).alias("statement_md5"), evidence.alias("evidence"))
    own = F.array(facet("biography", F.split_part("text", F.lit("."), F.lit(1)), F.col("source")), facet("voice_style", F.substring("text", 1, 40), F.col("lang")))
    labels = t.labels.join(t.documents.select("doc_id"), "doc_id").select("doc_id", F.lit("decision_patterns").alias("bucket"), md5(F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("statement_md5"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("evidence"))
    return t.documents.select("doc_id", F.inline(own)).unionByName(labels)


@query("""
WITH n AS (SELECT page_id, '---' || chr(10) || 'title: ' || coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') || chr(10) || 'url: ' || url || chr(10) || '---' || chr(10) || 'See [[' || split_part(url, '/', 3) || ']] and [[home|start]].' AS body FROM pages)
SELECT page_id, regexp_extract(body, 'title: ([^\n]*)', 1) AS title, length(regexp_extract(body, '(?s)^---\n(.*?)\n---', 1))::BIGINT AS front_length, array_to_string(regexp_extract_all(body, '\\[\\[([^\\]|#]+)', 1), ',') AS links FROM n
""".replace("\\n", "\n").replace("\\\\", "\\"))
def wiki_notes(t: Tables) -> DataFrame:
    """Pages as notes with front matter and links, read back."""
    title = first_given(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("none"))
    body = F.concat(F.lit("---\ntitle: "), title, F.lit("\nurl: "), F.col("url"), F.lit("\n---\nSee [["), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("]] and [[home|start]]."))
    n = t.pages.select("page_id", body.alias("body"))
    return n.select("page_id", F.regexp_extract(tx.front_matter(F.col("body")), "title: ([^\n]*)", 1).alias("title"), F.length(tx.front_matter(F.col("body"))).cast("bigint").alias("front_length"), F.array_join(tx.note_links(F.col("body")), ",").alias("links"))


@query(r"""
WITH x AS (SELECT page_id, url, 'v' || (page_id % 30) || '.' || (page_id % 7) || '.0' AS version, CASE page_id % 6 WHEN 0 THEN '<TODO>' WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN '{{your name}}' ELSE url END AS owner,
  chr(9) || ' ' || split_part(url, '://', 1) || chr(10) AS spaced FROM pages)
SELECT page_id, (page_id % 30)::INT AS major, owner IS NULL OR trim(owner) = '' OR owner IN ('<TODO>', '{{your name}}') AS unfilled, split_part(url, '://', 1) AS trimmed,
  CASE WHEN length(split_part(url, '://', 1)) < 5 THEN rpad(split_part(url, '://', 1), 5, '.') ELSE split_part(url, '://', 1) END AS padded, 'note ' || page_id || ' of ' || coalesce(owner, '') AS filled FROM x
""")
def field_functions(t: Tables) -> DataFrame:
    """Leading number of a version, placeholders, trim of all white space, padding that never cuts, filled templates."""
    k = F.col("page_id")
    version = F.concat(F.lit("v"), (k % 30).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(".0"))
    owner = F.when(k % 6 == 0, "<TODO>").when(k % 6 == 1, " ").when(k % 6 == 2, None).when(k % 6 == 3, "{{your name}}").otherwise(F.col("url"))
    scheme = F.split_part("url", F.lit("://"), F.lit(1))
    return t.pages.select(
        "page_id", tx.leading_integer(version).alias("major"), tx.is_placeholder(owner).alias("unfilled"), tx.trimmed(F.concat(F.lit("\t "), scheme, F.lit("\n"))).alias("trimmed"),
        tx.padded(scheme, 5, ".").alias("padded"), tx.filled(F.lit("note {{id}} of {{owner}}"), {"id": k, "owner": owner}).alias("filled"),
    )


@query("""
WITH f AS (SELECT 'biography' AS bucket, md5(split_part(text, '.', 1)) AS statement, source AS evidence, doc_id FROM documents
  UNION ALL SELECT 'voice_style', md5(lower(substr(text, 1, 40))), lang, doc_id FROM documents UNION ALL SELECT 'voice_style', md5(substr(text, 1, 40)), lang, doc_id FROM documents)
SELECT bucket, statement, min(doc_id) AS first_doc, count(*) AS times, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence FROM f GROUP BY bucket, statement
""")
def facets_merged(t: Tables) -> DataFrame:
    """Facets of several passes merged: equal statements of a bucket become one, with all their evidence."""
    md5 = lambda c: F.md5(c.cast("binary"))
    facet = lambda bucket, statement, evidence: F.struct(F.lit(bucket).alias("bucket"), md5(statement).alias("statement"), evidence.alias("evidence"))
    head = F.substring("text", 1, 40)
    own = t.documents.select("doc_id", F.inline(F.array(facet("biography", F.split_part("text", F.lit("."), F.lit(1)), F.col("source")), facet("voice_style", F.lower(head), F.col("lang")), facet("voice_style", head, F.col("lang")))))
    return own.groupBy("bucket", "statement").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("times"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))


@query(r"""
WITH f AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, source AS domain, sha256(text) AS sha, text FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\s*')) AS lines FROM f),
n AS (SELECT *, coalesce(nullif(trim(substr(regexp_replace(coalesce(lines[1], ''), '^#+ *', ''), 1, 60)), ''), path) AS title FROM l),
s AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '') AS stem FROM n)
SELECT doc_id, title, coalesce(stem || '-', '') || substr(md5(path), 1, 8) AS name, domain,
  md5('---' || chr(10) || 'title: ' || title || chr(10) || 'aliases: []' || chr(10) || 'domain: ' || domain || chr(10) || 'updated: ' || chr(10) || 'provenance: ' || path || ' ' || sha || chr(10) || '---' || chr(10) || text) AS note_md5
FROM s
""".replace("\\\\", "\\"))
def compiled_notes(t: Tables) -> DataFrame:
    """Documents as inbox files, compiled to notes."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = t.documents.select(path.alias("path"), F.col("source").alias("domain"), F.lit(None).cast("timestamp").alias("changed"), F.sha2("text", 256).alias("sha"), F.col("text").alias("body"))
    made = notes.compiled(files)
    doc_id = F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("bigint")
    return made.select(doc_id.alias("doc_id"), "title", "name", "domain", F.md5(F.col("note").cast("binary")).alias("note_md5"))


@query("""
WITH d AS (SELECT doc_id, source, '---' || chr(10) || 'title: ' || source || chr(10) || 'always_on: ' || CASE WHEN doc_id % 10 = 0 THEN 'true' ELSE 'false' END || chr(10) || '---' || chr(10) || 'Thinking aloud.' AS body, doc_id % 20 = 0 AS sensitive FROM documents)
SELECT doc_id, source AS title FROM d WHERE doc_id % 10 = 0 AND NOT sensitive
""")
def always_on_docs(t: Tables) -> DataFrame:
    """Documents that every session gets: those whose front matter says so and that aren't sensitive; talk before the front matter is dropped."""
    flag = F.when(F.col("doc_id") % 10 == 0, "true").otherwise("false")
    body = F.concat(F.lit("Here is the document.\n---\ntitle: "), F.col("source"), F.lit("\nalways_on: "), flag, F.lit("\n---\nThinking aloud."))
    d = t.documents.select("doc_id", tx.without_preamble(body).alias("body"), (F.col("doc_id") % 20 == 0).alias("sensitive"))
    front = tx.front_matter(F.col("body"))
    return d.filter(front.rlike(r"(?m)^always_on:\s*true\s*$") & ~F.col("sensitive")).select("doc_id", F.regexp_extract(front, r"(?m)^title:\s*(.*)$", 1).alias("title"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+\s'), lambda s: length(trim(s)) > 0) AS sentences FROM documents)
SELECT doc_id, len(sentences)::BIGINT AS n_sentences, md5(trim(coalesce(sentences[1], ''))) AS first_md5 FROM w
""".replace("\\\\", "\\"))
def extractive_summaries(t: Tables) -> DataFrame:
    """A stand-in for written summaries: a document's number of sentences and its first one."""
    sentences = F.filter(F.split("text", r"[.!?]+\s"), lambda s: F.length(F.trim(s)) > 0)
    d = t.documents.select("doc_id", sentences.alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.trim(F.coalesce(F.get("s", 0), F.lit(""))).cast("binary")).alias("first_md5"))


@query("""
SELECT page_id, len(list_filter(string_split(html, '>'), lambda l: len(list_filter(string_split(l, '"'), lambda w: len(list_filter(string_split(w, '/'), lambda x: x = 'the' OR x = 'der')) > 0)) > 0)) > 0 AS some_link,
  len(list_filter(string_split(html, '>'), lambda l: len(list_filter(string_split(l, '"'), lambda w: length(w) >= 4000)) > 0)) = 0 AS all_short FROM pages
""")
def nested_some(t: Tables) -> DataFrame:
    """Some tag has some attribute with some part of a name; every part of every tag is short."""
    tags = F.split("html", ">")
    some = F.exists(tags, lambda tag: F.exists(F.split(tag, '"'), lambda word: F.exists(F.split(word, "/"), lambda x: x.isin("the", "der"))))
    every = F.forall(tags, lambda tag: F.forall(F.split(tag, '"'), lambda word: F.length(word) < 4000))
    return t.pages.select("page_id", some.alias("some_link"), every.alias("all_short"))


#: Words of the given tables that stand for remarks on style.
STYLE_WORDS = ["whan", "thes", "erand"]


@query(f"""
SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations
WHERE role = 'user' AND regexp_matches(lower(text), '\\b({"|".join(STYLE_WORDS)})') AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(lower(text), '{"|".join(LEXICON)}')
""")
def voice_corrections(t: Tables) -> DataFrame:
    """What users say on style and nothing else: remarks with numbers, which may state facts, and clinical ones are left out."""
    text = F.col("text")
    styled = F.lower(text).rlike(r"\b(" + "|".join(STYLE_WORDS) + ")")
    own = t.conversations.filter((F.col("role") == "user") & styled & ~text.rlike("[0-9]") & ~tx.is_clinical(text, LEXICON))
    return own.select("conv_id", "turn", F.md5(text.cast("binary")).alias("text_md5"))
