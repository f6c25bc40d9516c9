"""The data model: audience scopes, profiles, and the retrieval settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Audience scopes from the most private to the most shareable.
SCOPES = ["clinical", "private", "personal", "professional", "public"]
#: Built-in profiles and the lowest scope that each may see.
PROFILES = {"full": "private", "work": "professional", "public": "public"}


@dataclass(frozen=True)
class Settings:
    """Fixed values of retrieval and evaluation; thresholds for the given vectors are parameters of the queries."""

    threshold: float = 0.62
    top_k: int = 4
    rerank_pool: int = 16
    rerank_chars: int = 400
    rerank_high: float = 0.30
    rerank_low: float = 0.02
    boost: float = 0.15
    drift_alarm: float = 0.05


SETTINGS = Settings()
#: The given vectors are nearly orthogonal: their cosines stay below 0.5.
FIXTURE_THRESHOLD = 0.2


def scope_rank(scope: Column) -> Column:
    """1 for the most private scope; null for an unknown one, which no profile may see."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SCOPES)), scope), F.lit(0))


def admits(scope: Column, ceiling: Column) -> Column:
    """Whether a profile with this ceiling may see an item of this scope."""
    return F.coalesce(scope_rank(scope) >= scope_rank(ceiling), F.lit(False))


def derived_scope(doc_id: Column) -> Column:
    """The given documents carry no scope: it follows from the id."""
    return F.element_at(F.array(*map(F.lit, SCOPES)), (F.pmod(doc_id, F.lit(len(SCOPES))) + 1).cast("int"))


SCOPE_SQL = "CASE doc_id % 5 WHEN 0 THEN 'clinical' WHEN 1 THEN 'private' WHEN 2 THEN 'personal' WHEN 3 THEN 'professional' ELSE 'public' END"
RANK_SQL = "CASE {} WHEN 'clinical' THEN 1 WHEN 'private' THEN 2 WHEN 'personal' THEN 3 WHEN 'professional' THEN 4 WHEN 'public' THEN 5 END"
PROFILES_SQL = "(VALUES ('full', 'private'), ('work', 'professional'), ('public', 'public')) AS profiles(profile, ceiling)"
