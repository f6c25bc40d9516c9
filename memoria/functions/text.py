"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a statement as clinical; may be given anew.
CLINICAL_WORDS = ["diagnosis", "therapy", "medication", "symptom", "clinic", "patient", "anxiety", "depress"]
#: The plain form is for SQL engines that search in linear time anyhow.
PLAIN_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
#: The border before the local part (or the end of the match before) and possessive repeats keep the search in proportion to the text, and its stack flat.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def slug(text: Column) -> Column:
    """Lower case, other runs as one dash, without a dash at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def is_clinical(text: Column, words: list[str] = CLINICAL_WORDS) -> Column:
    return F.lower(text).rlike("|".join(words))


def scrubbed(text: Column) -> Column:
    """E-mail addresses and phone numbers replaced by marks."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), PHONE, "[phone]")


FIRST_YEAR = 1990


def loose_date(text: Column, today: Column | None = None) -> Column:
    """A date from YYYY-MM-DD, YYYY-MM or YYYY from FIRST_YEAR to today; null otherwise. A month or year counts from its first day."""
    found = F.regexp_extract(text, r"(?<![0-9])(19[0-9]{2}|20[0-9]{2})(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?(?![0-9])", 0)
    full = F.when(F.length(found) == 4, F.concat(found, F.lit("-01-01"))).when(F.length(found) == 7, F.concat(found, F.lit("-01"))).when(F.length(found) == 10, found)
    date = F.try_to_date(full, "yyyy-MM-dd")
    return F.when(date.between(F.lit(f"{FIRST_YEAR}-01-01").cast("date"), F.current_date() if today is None else today), date)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def padded(text: Column, size: int, fill: str = " ") -> Column:
    """Filled up at its end to `size` characters; a longer text stays whole."""
    return F.when(F.length(text) < size, F.rpad(text, size, fill)).otherwise(text)


def leading_integer(version: Column) -> Column:
    """The number that a version begins with (an initial v aside); null without one."""
    return F.regexp_extract(trimmed(version), r"^v?([0-9]{1,9})", 1).try_cast("int")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """`template` with each {{name}} replaced by its value; a null value counts as empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


#: What a field is filled with before anybody fills it.
PLACEHOLDERS = ["todo", "tbd", "your name", "changeme", "..."]


def is_placeholder(value: Column) -> Column:
    """Null, blank, or one of the words that stand for a value to come, also in brackets."""
    bare = F.lower(F.regexp_replace(trimmed(value), r"^[<\[{]+|[>\]}]+$", ""))
    return F.coalesce((bare == "") | bare.isin(PLACEHOLDERS), F.lit(True))


def chunks(words: Column, size: int, step: int) -> Column:
    """Windows of `size` words, `step` apart; the last one may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step))
    return F.transform(starts, lambda i: F.slice(words, i, size))


#: A border between chunks stands behind a word where the digest of the WINDOW words up to it begins with BORDER: behind every 256th on average.
WINDOW, BORDER = 4, "00"
#: Stretches without a border are cut every so many words.
LONGEST = 1024


def content_chunks(words: Column) -> Column:
    """Chunks whose borders follow from the words around them, so that a change of some words changes the chunks it touches and leaves the others as they are."""

    def cut(all_: Column) -> Column:
        n = F.size(all_)
        ends = F.filter(F.when(n >= WINDOW, F.sequence(F.lit(WINDOW), n)).otherwise(F.array().cast("array<int>")), lambda i: F.md5(F.array_join(F.slice(all_, i - WINDOW + 1, WINDOW), " ").cast("binary")).startswith(BORDER))
        ends = F.array_distinct(F.array_append(ends, n))
        return F.get(F.transform(F.array(ends), lambda e: F.flatten(F.transform(e, lambda end, k: pieces(all_, F.when(k > 0, F.get(e, k - 1)).otherwise(0), end)))), 0)

    def pieces(all_: Column, begin: Column, end: Column) -> Column:
        starts = F.when(end > begin, F.sequence(begin, end - 1, F.lit(LONGEST))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(all_, s + 1, F.least(F.lit(LONGEST), end - s)))

    return F.get(F.transform(F.array(words), cut), 0)


def front_matter(body: Column) -> Column:
    return F.regexp_extract(body, r"(?s)^---\n(.*?)\n---", 1)


def note_links(body: Column) -> Column:
    """Targets of [[links]], without alias and heading."""
    return F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def without_preamble(body: Column) -> Column:
    """What comes before the front matter taken off; a body without one stays as it is."""
    at = F.locate("---\n", body)
    return F.when((at > 1) & F.contains(F.substring(body, at + 4, F.length(body)), F.lit("\n---")), F.substring(body, at, F.length(body))).otherwise(body)
