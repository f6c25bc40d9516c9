"""URL filter by the ratio of two character language models.

Rules decide some urls; those that they allow or block are the samples of accepted and rejected urls from which two
variable-order Markov models are counted. A character's probability after its context is smoothed by orders:
(count + STRENGTH * probability one order lower) / (context count + STRENGTH), down to the uniform one. A url's score
is the mean over its characters of the difference of log probabilities, at the longest context either model has seen.
The threshold is calibrated on labelled urls that are not counted: midway between the mean scores of the accepted and
of the rejected (of the counted ones where there are no others).

Native: DataFrame functions only. What is gathered are counts of distinct grams, added up before the shuffle. Urls
meet gram scores in an equi-join to which the scores of hot grams are broadcast; pages meet url scores likewise.

Defined cases: a null url or one without `://` has an empty host and path and scores what its own characters give (an empty one 0);
without samples of both kinds every score is 0 and the threshold 0, so the verdict is allow; a null page_id is an
ordinary value; repeated rows are judged alike and count as often in the models; extra columns are kept, those named as the
results replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import joined_by_key, table, unused, written

#: What to do, host (with its subdomains), beginning of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
ORDER = 5
STRENGTH = 2.0
ALPHABET = 128
#: First hex digits of the md5 of urls that calibrate the threshold and aren't counted.
HELD_OUT = ("0", "1", "2")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path; the host's A-Z are lower-cased."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def rule_columns(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def characters(url: Column) -> Column:
    """What the models read: the url in lower case behind the scheme, with a mark on either end."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z]+://", "")
    return F.when(plain == "", "").otherwise(F.concat(F.lit("\x02"), plain, F.lit("\x03")))


def grams_of(chars: Column) -> Column:
    """For each character behind the first mark, it and up to ORDER before it."""
    size = F.length(chars)
    return F.when(size < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(2), size), lambda i: F.substring(chars, F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))))
    )


def model(learned: DataFrame) -> DataFrame:
    """(g, n, difference) of every gram g of n characters, n up to ORDER + 1, that is an ending in `learned(gram, good, times)`.

    The difference of the models' log probabilities of the gram's last character after the others.
    """
    of = lambda good: F.sum(F.when(F.col("good") == good, F.col("times")).otherwise(0))
    long = learned.groupBy("gram").agg(of(True).alias("ok"), of(False).alias("bad"))
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.struct(n.alias("n"), F.substring(F.col("gram"), F.length("gram") - n + 1, n).alias("g")))
    counts = long.select("ok", "bad", F.inline(ends)).groupBy("g", "n").agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad"))
    counts = written(counts.withColumn("context", F.substring(F.col("g"), F.lit(1), F.col("n") - 1)), "url-grams")
    contexts = counts.groupBy("context", "n").agg(F.sum("ok").alias("all_ok"), F.sum("bad").alias("all_bad"))
    smoothed, parts = None, []
    for n in range(1, ORDER + 2):
        own = counts.filter(F.col("n") == n).join(contexts.filter(F.col("n") == n).drop("n"), "context").withColumn("below", F.substring(F.col("g"), F.lit(2), F.lit(n - 1)))
        if smoothed is None:
            own = own.withColumns({"low_ok": F.lit(1.0 / ALPHABET), "low_bad": F.lit(1.0 / ALPHABET)})
        else:
            own = own.join(smoothed.select(F.col("g").alias("below"), F.col("p_ok").alias("low_ok"), F.col("p_bad").alias("low_bad")), "below")
        p = lambda k: ((F.col(k) + STRENGTH * F.col(f"low_{k}")) / (F.col(f"all_{k}") + STRENGTH)).alias(f"p_{k}")
        smoothed = written(own.select("g", "n", p("ok"), p("bad")), "url-model")
        parts.append(smoothed)
    return reduce(DataFrame.unionByName, parts).select("g", "n", (F.ln("p_ok") - F.ln("p_bad")).alias("difference"))


def gram_gains(grams: DataFrame, differences: DataFrame) -> DataFrame:
    """(gram, times, gain) of each distinct gram: how often it occurs, and the difference at the longest ending that the models know (null if none)."""
    own = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times")), "url-distinct-grams")
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.substring(F.col("gram"), F.length("gram") - n + 1, n))
    tried = own.select("gram", F.explode(ends).alias("g"))
    gains = tried.join(differences, "g").groupBy("gram").agg(F.max_by("difference", "n").alias("gain"))
    return written(own.join(gains, "gram", "left"), "url-gains")


def scored_urls(urls: DataFrame) -> tuple[DataFrame, float]:
    """(distinct urls with rule verdict and score, threshold) of urls(url, ruled). Each distinct url is taken apart once."""
    urls = urls.groupBy("url").agg(F.first("ruled").alias("ruled"), F.count(F.lit(1)).alias("times"))
    urls = urls.withColumn("held", F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD_OUT))
    grams = urls.select("*", F.explode(grams_of(characters(F.col("url")))).alias("gram"))
    learned = grams.filter(F.col("ruled").isNotNull() & ~F.col("held")).select("gram", (F.col("ruled") == "allow").alias("good"), "times")
    gains = gram_gains(grams, model(learned))
    means = joined_by_key(grams.select("url", "gram"), gains, "gram").groupBy("url").agg(F.round(F.avg(F.coalesce("gain", F.lit(0.0))), 6).alias("score"))
    scored = written(urls.join(means, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "url-scores")
    by_kind = {(r["ruled"], r["held"]): r["mean"] for r in scored.filter("ruled is not null").groupBy("ruled", "held").agg((F.sum(F.col("score") * F.col("times")) / F.sum("times")).alias("mean")).collect()}
    if ("allow", False) not in by_kind or ("block", False) not in by_kind:
        return scored.withColumn("score", F.lit(0.0)), 0.0
    a, b = (by_kind.get((kind, True), by_kind[kind, False]) for kind in ("allow", "block"))
    return scored, round((a + b) / 2, 4)


def judge(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """`pages` with host, path, rule, score and verdict."""
    df = with_host_and_path(pages.drop("rule", "score", "verdict"), url_col)
    ruled, url = unused(df, "_ruled", "_url")
    rule, by_rule = rule_columns(F.col("host"), F.col("path"))
    df = df.withColumns({"rule": rule, ruled: by_rule, url: F.coalesce(F.col(url_col), F.lit(""))})
    scored, threshold = scored_urls(df.select(F.col(url).alias("url"), F.col(ruled).alias("ruled")))
    joined = joined_by_key(df, scored.select(F.col("url").alias(url), "score", "times"), url)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return joined.withColumn("verdict", F.coalesce(ruled, by_model)).drop(ruled, url)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that fits, the verdict, and the model's score."""
    df = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return df.select("page_id", "host", "path", "rule", "verdict", "score")


def _levels() -> str:
    """The models' orders, one after the other."""
    out = ""
    for n in range(1, ORDER + 2):
        low = f"1e0 / {ALPHABET}" if n == 1 else "b.p_{k}"
        below = "" if n == 1 else f" JOIN m{n - 1} b ON b.g = substr(c.g, 2)"
        p = ", ".join(f"(c.{k} + {STRENGTH}e0 * {low.format(k=k)}) / (sum(c.{k}) OVER (PARTITION BY substr(c.g, 1, {n - 1})) + {STRENGTH}e0) AS p_{k}" for k in ("ok", "bad"))
        out += f"m{n} AS (SELECT c.g, {n} AS n, {p} FROM counts c{below} WHERE c.n = {n}), "
    return out


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id, u, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM p
), hp AS (
  SELECT page_id, u, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h
), rules(what, rh, rp) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), fit AS (
  SELECT page_id, u, host, path,
    (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT arg_max(what, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS ruled
  FROM hp
), urls AS (
  SELECT u, any_value(ruled) AS ruled, count(*) AS times, substr(md5(u), 1, 1) IN {HELD_OUT} AS held,
    regexp_replace(lower(u), '^[a-z]+://', '') AS bare FROM fit GROUP BY u
), chars AS (
  SELECT u, ruled, times, held, chr(2) || bare || chr(3) AS c FROM urls WHERE bare <> ''
), grams AS (
  SELECT u, ruled, times, held, substr(c, greatest(i - {ORDER}, 1), least(i, {ORDER + 1})) AS gram
  FROM chars, unnest(range(2, length(c) + 1)) AS r(i)
), long AS (
  SELECT gram, sum(CASE WHEN ruled = 'allow' THEN times ELSE 0 END) AS ok, sum(CASE WHEN ruled = 'block' THEN times ELSE 0 END) AS bad
  FROM grams WHERE ruled IS NOT NULL AND NOT held GROUP BY gram
), counts AS (
  SELECT substr(gram, length(gram) - n + 1) AS g, n, sum(ok)::DOUBLE AS ok, sum(bad)::DOUBLE AS bad
  FROM long, unnest(range(1, length(gram) + 1)) AS r(n) GROUP BY 1, 2
), {_levels()}model AS (
  {" UNION ALL ".join(f"SELECT g, n, ln(p_ok) - ln(p_bad) AS difference FROM m{n}" for n in range(1, ORDER + 2))}
), distinct_grams AS (
  SELECT DISTINCT gram FROM grams
), tried AS (
  SELECT gram, n, substr(gram, length(gram) - n + 1) AS g FROM distinct_grams, unnest(range(1, length(gram) + 1)) AS r(n)
), gains AS (
  SELECT gram, arg_max(difference, n) AS gain FROM (SELECT t.gram, m.n, m.difference FROM tried t JOIN model m USING (g)) GROUP BY gram
), means AS (
  SELECT u, round(avg(coalesce(gain, 0e0)), 6) AS score FROM grams LEFT JOIN gains USING (gram) GROUP BY u
), scored AS (
  SELECT urls.*, coalesce(score, 0e0) AS score FROM urls LEFT JOIN means USING (u)
), kind AS (
  SELECT ruled, coalesce(sum(score * times) FILTER (held) / sum(times) FILTER (held), sum(score * times) / sum(times)) AS mean,
    count(*) FILTER (NOT held) AS counted FROM scored WHERE ruled IS NOT NULL GROUP BY ruled
), threshold AS (
  SELECT round(sum(mean) / 2, 4) AS t, count(*) FILTER (counted > 0) = 2 AS both_kinds FROM kind
)
SELECT page_id, host, path, rule, coalesce(fit.ruled, CASE WHEN NOT both_kinds OR score >= t THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN both_kinds THEN score ELSE 0e0 END AS score
FROM fit JOIN scored USING (u), threshold
"""
