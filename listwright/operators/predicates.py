"""Row predicates and facet tags. Every one of them is a Column on one listing row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions.scalars import required_years
from listwright.functions.text import (
    END, START, UNICODE, any_of, bind, contains_any, joined, strip, text_or_empty, whole,
)


def _tags_text() -> Column:
    return F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")


# ------------------------------------------------------------------ ingest gates
def gate_text() -> Column:
    return F.lower(F.concat(text_or_empty("title"), F.lit("\n"), text_or_empty("description")))


def passes_keywords(text: Column, keywords: Iterable[str]) -> Column:
    """At least one keyword as a word, a short technical suffix allowed."""
    keywords = list(keywords)
    if not keywords:
        return F.lit(True)
    wanted = [k.strip().lower() for k in keywords if k and k.strip()]
    if not wanted:
        return F.lit(False)
    return text.rlike(f"{START}{any_of(wanted)}{fv.GATE_SUFFIX}{END}")


def is_blocked(text: Column, blocked: Iterable[str]) -> Column:
    return contains_any(text, [b.lower() for b in blocked if b])


def passes_gate(
    source: Column, text: Column, keywords: Iterable[str], blocked: Iterable[str]
) -> Column:
    """Blocked phrases always drop; sources that are filtered upstream skip the keywords."""
    keywords, blocked = list(keywords), list(blocked)
    return bind(
        text,
        lambda t: ~is_blocked(t, blocked)
        & (source.isin(fv.PRE_FILTERED_SOURCES) | passes_keywords(t, keywords)),
    )


# ------------------------------------------------------------------ feed filters
def status_filter(status: str | None) -> Column:
    if status in (None, "", "active"):
        return F.col("status") != "ignored"
    return F.lit(True) if status == "all" else F.col("status") == status


def min_score(n: int | None) -> Column:
    return F.col("ai_score") >= n if n else F.lit(True)


def effective_time() -> Column:
    return F.coalesce("posted_at", "fetched_at")


def posted_within(days: int | None, as_of: Column) -> Column:
    if not days or days <= 0:
        return F.lit(True)
    return effective_time() >= as_of - F.make_dt_interval(F.lit(days))


def is_freelance() -> Column:
    text = F.lower(joined(" ", F.col("title"), _tags_text(), F.col("budget")))
    return (
        (F.col("source") == fv.FREELANCE_SOURCE)
        | contains_any(text, fv.FREELANCE_SUBSTRINGS)
        | text.rlike(START + any_of(fv.FREELANCE_WORDS))
    )


def in_region(key: str) -> Column:
    phrases, tokens = next(((p, t) for k, p, t in fv.REGIONS if k == key), (None, None))
    if phrases is None:
        return F.lit(True)
    text = joined(" ", F.col("location"), F.col("title"), _tags_text())
    hit = F.lower(text).rlike(whole(any_of(phrases)))
    if tokens:
        hit |= text.rlike(f"(?<![A-Za-z]){any_of(tokens)}(?![A-Za-z])")
    return hit


def employment_text() -> Column:
    return F.lower(joined(" ", F.col("title"), _tags_text(), F.col("budget"), F.col("description")))


def has_employment_type(key: str, text: Column | None = None) -> Column:
    pattern, open_end = next(((p, o) for k, p, o in fv.EMPLOYMENT_TYPES if k == key), (None, None))
    if pattern is None:
        return F.lit(True)
    text = employment_text() if text is None else text
    hit = text.rlike(f"{UNICODE}{START}(?:{pattern}){'' if open_end else END}")
    return hit | (F.col("source") == fv.FREELANCE_SOURCE) if key == "freelance" else hit


def has_experience_level(key: str) -> Column:
    pattern, deep = next(((p, d) for k, p, d in fv.EXPERIENCE_LEVELS if k == key), (None, None))
    if pattern is None:
        return F.lit(True)
    parts = [text_or_empty("title"), _tags_text()]
    if deep:
        parts.append(text_or_empty("description"))
    return F.lower(F.concat_ws(" ", *parts)).rlike(UNICODE + whole(pattern))


def _any_known(keys: Iterable[str] | None, known: list[str], test) -> Column:
    wanted = [k for k in keys or [] if k in known]
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for key in wanted:
        hit |= test(key)
    return hit


def any_employment_type(keys: Iterable[str] | None) -> Column:
    known = [k for k, *_ in fv.EMPLOYMENT_TYPES]
    if not any(k in known for k in keys or []):
        return F.lit(True)
    return bind(
        employment_text(), lambda t: _any_known(keys, known, lambda k: has_employment_type(k, t))
    )


def any_experience_level(keys: Iterable[str] | None) -> Column:
    return _any_known(keys, [k for k, *_ in fv.EXPERIENCE_LEVELS], has_experience_level)


def max_years(n: int | None) -> Column:
    if n is None or not 0 <= n < fv.MAX_YEARS_ANY:
        return F.lit(True)
    return F.coalesce(required_years("title", "description") <= n, F.lit(True))


# ------------------------------------------------------------------ facet tags
def _matching(keys: list[str], test) -> Column:
    """Keys whose test holds, in table order, as one array (no join, no row growth)."""
    return F.array_compact(F.array(*[F.when(test(k), F.lit(k)) for k in keys]))


def region_tags() -> Column:
    return _matching([k for k, *_ in fv.REGIONS], in_region)


def employment_tags() -> Column:
    keys = [k for k, *_ in fv.EMPLOYMENT_TYPES]
    return bind(employment_text(), lambda t: _matching(keys, lambda k: has_employment_type(k, t)))


def experience_tags() -> Column:
    return _matching([k for k, *_ in fv.EXPERIENCE_LEVELS], has_experience_level)


# ------------------------------------------------------------------ workflow predicates
def unscored_and_retryable() -> Column:
    return F.col("ai_score").isNull() & (F.col("ai_attempts") < fv.MAX_SCORE_ATTEMPTS)


def alertable(threshold: int) -> Column:
    return (
        (F.col("ai_score") >= threshold)
        & F.col("notified_at").isNull()
        & (F.col("status") != "ignored")
    )


def on_board() -> Column:
    return F.col("status").isin(fv.TRACKER_COLUMNS)


def has_text(c: str) -> Column:
    return strip(text_or_empty(c)) != ""
