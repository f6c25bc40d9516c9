"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Native: DataFrame functions only; work grows in proportion to a text's length and (but for a root) its spans. Defined cases: a null
or empty text has no spans; extra columns are kept and never read (one named as the result is replaced); repeated rows give repeated results; an empty table gives an empty result.
Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import NO_SPANS, apart_from, bound, count_kind, ordered, parts_of, piece, regex_spans, running, spans_text, table, unused

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "local_phone", "ssn"]
KINDS = BASE_KINDS + ADDED_KINDS

#: A run's start, or where the last match ended: matches can start nowhere else, so long runs stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 16 to 19 digits with single blanks or hyphens between them.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Words near a span that make a kind likelier, and the span's score before that.
CONTEXT = {
    "email": (r"\b(mail|email|e-mail|contact|write)\b", 0.8),
    "ip": (r"\b(ip|address|host|server|login)\b", 0.6),
    "card": (r"\b(card|visa|mastercard|credit|payment|pay)\b", 0.8),
    "phone": (r"\b(phone|tel|telephone|call|mobile|fax|contact)\b", 0.6),
    "iban": (r"\b(iban|bank|account|transfer)\b", 0.7),
    "local_phone": (r"\b(phone|tel|telephone|call|mobile|fax|contact)\b", 0.3),
    "ssn": (r"\b(ssn|social security)\b", 0.3),
}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 40
MIN_SCORE = 0.5


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right doubled, digit sums added, divisible by ten."""
    digits = F.reverse(digits_of(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The bank account check: first four characters to the end, letters as 10 to 35, remainder 1."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def fold(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), fold) == 1


def valid(span: Column) -> Column:
    value = span["value"]
    parts = F.split(value, r"\.")
    n_digits = F.length(digits_of(value))
    return (
        F.when(span["kind"] == "ip", F.forall(parts, lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
        .when(span["kind"] == "card", luhn(value))
        .when(span["kind"] == "phone", n_digits.between(8, 15))
        .when(span["kind"] == "iban", mod97(value))
        .otherwise(F.lit(True))
    )


def scored(span: Column, parts: Column) -> Column:
    """The span with its score raised where a context word stands near it; `parts` are those of its text."""
    around = F.lower(piece(parts, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), span["end"] + CONTEXT_CHARS))
    near = F.lit(False)
    for kind, (words, _) in CONTEXT.items():
        near = near | ((span["kind"] == kind) & around.rlike(words))
    score = span["score"] + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))


def pii_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, added candidates) of a non-null text."""
    base = F.concat(
        regex_spans(text, "email", EMAIL, CONTEXT["email"][1], F.contains(text, F.lit("@"))),
        regex_spans(text, "ip", IP, CONTEXT["ip"][1], F.contains(text, F.lit("."))),
        regex_spans(text, "card", CARD, CONTEXT["card"][1], F.lit(True)),
        regex_spans(text, "phone", PHONE, CONTEXT["phone"][1], F.contains(text, F.lit("+"))),
    )
    added = F.concat(
        regex_spans(text, "iban", IBAN, CONTEXT["iban"][1], F.lit(True)),
        regex_spans(text, "local_phone", LOCAL_PHONE, CONTEXT["local_phone"][1], F.lit(True)),
        regex_spans(text, "ssn", SSN, CONTEXT["ssn"][1], F.contains(text, F.lit("-"))),
    )
    return base, added


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """`docs` with an array of spans (kind, start, end, value, score) in column `out`, by kind, then start."""
    base, added, parts = unused(docs, "_base", "_added", "_parts")
    some, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(NO_SPANS)
    proposals = pii_spans(some)
    df = docs.withColumns({base: F.when(some.rlike("[0-9@]"), F.filter(proposals[0], valid)).otherwise(none), added: F.when(some.rlike("[0-9]{2}"), F.filter(proposals[1], valid)).otherwise(none)})
    df = df.withColumn(parts, F.when((F.size(base) > 0) | (F.size(added) > 0), parts_of(some)))
    df = df.withColumns({c: F.transform(c, lambda s: scored(s, F.col(parts))) for c in (base, added)})
    extra = apart_from(F.filter(added, lambda s: s["score"] >= MIN_SCORE), F.col(base))
    return df.withColumn(out, ordered(F.concat(F.col(base), extra), KINDS, by_kind=True)).drop(base, added, parts)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span replaced by its kind in brackets; of overlapping spans the first stands for all.

    Texts without spans stay as they are (null stays null).
    """
    (name,) = unused(docs, "_spans")
    df = find_pii(docs, text_col, name)
    text = F.col(text_col)

    def masked(of: Column) -> Column:
        told = running(F.transform(of["spans"], lambda s: s["end"]), F.lit(0).cast("bigint"), F.greatest)
        return bound(told, lambda ends: joined(of, ends))

    def joined(of: Column, ends: Column) -> Column:
        """`ends` has where the text before each span is told to, and at last where all is."""
        part = lambda s, at: F.when(s.isNull(), piece(of["parts"], at, F.length(text).cast("bigint"))).when(s["start"] >= at, F.concat(piece(of["parts"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.array_join(F.zip_with(of["spans"], ends, part), "")

    whole = F.struct(ordered(F.col(name), KINDS, by_kind=False).alias("spans"), parts_of(text).alias("parts"))
    return df.withColumn(text_col, F.when(F.size(name) > 0, bound(whole, masked)).otherwise(text)).drop(name)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of base kinds, digest of the base spans, and all spans."""
    df = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    counts = [count_kind(spans, k) for k in BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))
    return df.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))
