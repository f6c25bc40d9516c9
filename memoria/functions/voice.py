"""Remarks on how something is said, told apart from remarks on what is said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import is_clinical

#: Words (or their beginnings) by the side of style that they are about; a chosen rule, may be given anew.
STYLE = {
    "length": ["shorter", "longer", "concise", "wordy", "too long", "too short", "trim", "brief"],
    "tone": ["formal", "casual", "friendl", "stiff", "warmer", "tone", "polite", "blunt"],
    "wording": ["jargon", "rephras", "reword", "wording", "cliche", "simpler word", "passive", "my voice", "sounds like"],
    "format": ["bullet", "heading", "bold", "em dash", "paragraph", "emoji", "comma", "list"],
}
#: What marks a remark on facts: numbers, and words that dispute what is so.
FACTUAL = [r"[0-9]", r"\bnot true\b", r"\bincorrect\b", r"\bfactual", r"\bwrong (?:date|name|number|place)\b", r"\bactually\b", r"\bin fact\b", r"\bhappened\b"]


def style_kinds(text: Column, style: dict[str, list[str]] = STYLE) -> Column:
    """The sides of style that a text speaks of, in order of their names; none if it also disputes facts or is clinical."""
    low = F.lower(text)
    said = F.array(*(F.when(low.rlike(r"\b(?:" + "|".join(words) + ")"), F.lit(kind)) for kind, words in sorted(style.items())))
    about_style = ~low.rlike("|".join(FACTUAL)) & ~is_clinical(text)
    return F.when(F.coalesce(about_style, F.lit(False)), F.array_compact(said)).otherwise(F.array().cast("array<string>"))


def corrections(turns: DataFrame, style: dict[str, list[str]] = STYLE) -> DataFrame:
    """(conv_id, turn, kind, text) of turns(conv_id, turn, role, text): what a user says on style right behind a draft, a row for each side of it."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    own = turns.withColumn("_before", before).filter("role = 'user' and _before = 'assistant'")
    return own.select("conv_id", "turn", F.explode(style_kinds(F.col("text"), style)).alias("kind"), "text")
