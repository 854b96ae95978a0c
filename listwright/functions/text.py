"""Text building blocks: whitespace, word boundaries, escaping, ordered folds.

All of them return Column expressions, so they stay inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore in any script. Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"
START = rf"(?<!{WORD})"
END = rf"(?!{WORD})"
# Flag that makes \s and \d cover all scripts.
UNICODE = "(?U)"

# The characters that count as white space in feeds (Spark's trim knows only ' ').
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern; (?U) makes \s the white space of all scripts.
SPACE = r"[\s\x1c-\x1f]"
NO_SPACE = r"[^\s\x1c-\x1f]"
LINE_BREAK = r"[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape(literal: str) -> str:
    """Quote a literal so that it can be placed inside a Java regular expression."""
    return re.sub(r"([\x00-\x7f])(?<![A-Za-z0-9_])", r"\\\1", literal)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A Column that is used in several places is computed in each of them: filters are pushed
    below the projection that computed it, and lambdas compute it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Collapse runs of white space to one space and strip."""
    # Single blanks are what they should be already, and most of what there is.
    runs = f"{UNICODE}(?:{SPACE}{{2,}}|(?! ){SPACE})"
    return F.btrim(F.regexp_replace(col(c), runs, " "), F.lit(" "))


def opening(c: Column, n: int) -> Column:
    """The first ``n`` characters of the squeezed text.

    They lie within the first n / 2 words, so no more than that is squeezed.
    """
    words = f"{UNICODE}^{SPACE}*+(?:{NO_SPACE}++{SPACE}++){{0,{n // 2}}}+{NO_SPACE}*+"
    return F.substring(squeeze(F.regexp_extract(c, words, 0)), 1, n)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def joined(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither NULL nor empty."""
    return F.concat_ws(separator, *[empty_to_null(p) for p in parts])


def any_of(words: Iterable[str]) -> str:
    """Alternation of escaped literals."""
    return "(?:" + "|".join(escape(w) for w in words) + ")"


def whole(pattern: str) -> str:
    """The pattern with a word boundary on both sides."""
    return f"{START}(?:{pattern}){END}"


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def distinct_ci(items: Column) -> Column:
    """Distinct ignoring case, first spelling wins, order kept."""
    lowered = F.transform(items, lambda x: F.lower(x))
    return F.filter(
        items, lambda x, i: F.array_position(lowered, F.lower(x)) == (i + 1).cast("long")
    )


def clean_tags(items: Column) -> Column:
    """Strip every tag, drop the blank ones, then keep the first spelling of each."""
    stripped = F.filter(
        F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: strip(x)),
        lambda x: x.isNotNull() & (x != ""),
    )
    return distinct_ci(stripped)


def split_lines(c: Column) -> Column:
    """Stripped, non-blank lines as an array."""
    return F.filter(
        F.transform(F.split(text_or_empty(c), LINE_BREAK), lambda x: strip(x)), lambda x: x != ""
    )
