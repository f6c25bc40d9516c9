"""Secret scan by an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds one row for each blob and scan of it, with the
rule versions that were scanned and their findings. A scan takes the blobs of the given documents, leaves out
pairs of blob and rule version that the ledger has, scans each remaining blob once, appends to the ledger, and joins findings
of the rules' present versions back to every path (document) that holds the blob.

Native: DataFrame functions only. Defined cases: a null text counts as the empty text, which has no
findings; repeated rows each get the blob's findings; extra columns are kept, those named `blob` or `findings` replaced; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import NO_SPANS, SPAN, apart_from, count_kind, ordered, regex_spans, spans_text, table, written

BASE_KINDS = ["assign", "access", "hex"]
#: Kind, rule version, pattern, a cheap necessary condition.
RULES = [
    ("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None),
    ("access", 1, r"AKIA[A-Z0-9]++", "AKIA"),
    ("hex", 1, r"[0-9a-f]{24,}+", None),
    ("private_key", 1, r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----", "PRIVATE KEY"),
    # Its last alternative takes the rest of a run that is no token, or each `eyJ` of the run would be tried to the run's end; such matches aren't confirmed.
    ("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|eyJ[A-Za-z0-9_-]*+", "eyJ"),
    ("host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    ("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
]
KINDS = [r[0] for r in RULES]
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULE_VERSIONS = [f"{kind}@{version}" for kind, version, _, _ in RULES]
LEDGER_SCHEMA = "blob binary, rules array<string>, findings array<struct<rule:string,span:" + SPAN + ">>"


def confirmed(span: Column) -> Column:
    value = span["value"]
    return (
        F.when(span["kind"] == "assign", F.length(F.regexp_replace(value, ASSIGN_HEAD, "")) >= 6)
        .when(span["kind"] == "access", F.length(value) >= 20)
        .when(span["kind"] == "web_token", F.contains(value, F.lit(".")))
        .otherwise(F.lit(True))
    )


def named(spans: Column, rule: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rule).alias("rule"), s.alias("span")))


def findings_of(text: Column, due: Column) -> Column:
    """(rule version, span) of the rules that are due."""
    per_rule = []
    for (kind, _, pattern, needs), name in zip(RULES, RULE_VERSIONS, strict=True):
        possible = F.array_contains(due, name)
        spans = F.filter(regex_spans(text, kind, pattern, 1.0, possible & F.contains(text, F.lit(needs)) if needs else possible), confirmed)
        per_rule.append(named(spans, name))
    return F.concat(*per_rule)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen_scans(docs: DataFrame, ledger: DataFrame, text_col: str = "text") -> DataFrame:
    """The ledger's new rows: each blob with the rule versions that the ledger hasn't got for it, scanned once.

    A blob's text crosses the network once for each task that met it, never once for each copy; hot groups of copies
    shrink before the shuffle.
    """
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    texts = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    left = F.array_except(F.array(*map(F.lit, RULE_VERSIONS)), F.coalesce("done", F.array().cast("array<string>")))
    due = blobs.join(done, "blob", "left").select("blob", "text", left.alias("rules")).filter(F.size("rules") > 0)
    return written(due.select("blob", "rules", findings_of(F.col("text"), F.col("rules")).alias("findings")), "blob-ledger")


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(`docs` with columns `blob` and `findings`, the ledger's new rows). `ledger`: rows of LEDGER_SCHEMA from earlier scans.

    Of spans that overlap one of a base kind those of added kinds are left out.
    """
    ledger = ledger if ledger is not None else docs.sparkSession.createDataFrame([], LEDGER_SCHEMA)
    fresh = unseen_scans(docs, ledger, text_col)
    # Superseded rule versions stay in the ledger but aren't joined back.
    present = F.filter("findings", lambda f: f["rule"].isin(RULE_VERSIONS))
    found = ledger.unionByName(fresh).select("blob", F.transform(present, lambda f: f["span"]).alias("some")).filter(F.size("some") > 0)
    # A pair of blob and rule version may have been scanned twice by scans that ran at once.
    found = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("all"))
    base = F.filter("all", lambda s: s["kind"].isin(BASE_KINDS))
    added = apart_from(F.filter("all", lambda s: ~s["kind"].isin(BASE_KINDS)), base)
    found = found.select("blob", ordered(F.concat(base, added), KINDS, by_kind=False).alias("findings"))
    joined = docs.drop("findings").withColumn("blob", blob_of(F.col(text_col))).join(found, "blob", "left")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast(NO_SPANS))), fresh


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of base kinds, digest of the base spans, and all spans.

    The blobs whose address begins with a digit below 8 were scanned before; the table is then scanned against their ledger.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = docs.filter(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1) < "8")
    df, _ = scan(docs, scan(earlier)[1])
    spans = F.col("findings")
    counts = [count_kind(spans, k) for k in BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))
    return df.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def _kind_sql(order: int, kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''").replace("++", "+").replace("}+", "}").replace("*+", "*")
    return f"SELECT rid, {order} AS ord, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')"


_head = ASSIGN_HEAD.replace("'", "''")
_base = str(tuple(BASE_KINDS))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(i, kind, pattern) for i, (kind, _, pattern, _) in enumerate(RULES))}),
p AS (
  SELECT rid, ord, kind, hits[i] AS hit,
    (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS start
  FROM m, unnest(range(1, len(hits) + 1)) AS r(i)
), s AS (
  SELECT rid, ord, kind, start, start + length(hit) AS stop, kind IN {_base} AS base FROM p
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(hit, '{_head}', '')) >= 6 WHEN 'access' THEN length(hit) >= 20 WHEN 'web_token' THEN contains(hit, '.') ELSE true END
), k AS (
  SELECT * FROM s WHERE base OR NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.base AND b.start < s.stop AND s.start < b.stop)
), a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (base) AS base_text,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM k GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
