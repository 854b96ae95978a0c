"""A positional inverted index of texts, and word forms found in it by merging positions.

A *posting* is one word of one field of one row: (id, bit of the field, position, word, the word with what stands before and
behind it). Words are runs of letters and digits, lower-cased; what is between two words is the gap that both carry.

A *form* is a literal to be found, like ``web``, ``front end``, ``c++`` or ``.net``. It is taken apart into its words and
what has to stand around them. Every word of a form is looked up by equality. Word j of a form votes for the position at
which the form would begin, and a form is there where all of its words vote for one position. So no pattern is run over a
text, forms are searched once for all who ask for them, and a form of digits is looked up like any other.

``postings`` can be written as a table (bucketed by word, say) and be used for any number of searches.
"""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.text import escape, text_or_empty
from listwright.session import written

_WORD = r"[\p{L}\p{N}]"
_NO_WORD = r"[^\p{L}\p{N}]"
# Cuts pieces apart, and stands in a piece for the word on the other side of its gap. In texts and forms themselves
# another control character takes their place.
_CUT, _OTHER, _CONTROL = "\x01", "\x03", "\x02"
SEPARATOR = r"[\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}_\-/]+"
# What a word may carry behind it in a loose form; digits are looked up as stems, see ``_with_stems``.
SUFFIXES = ("", "s", "es", "js")

# How a form's words have to stand:
LOOSE = "loose"        # parts of a form may be apart by any separator, the last word may carry a suffix
LITERAL = "literal"    # as spelled; whether it stands free at either end is told, not asked for
FREE = "free"          # as spelled, standing free at the ends that are letters or digits


def _no_marks(text: Column) -> Column:
    marked = F.contains(text, F.lit(_CUT)) | F.contains(text, F.lit(_OTHER))
    return F.when(marked, F.translate(text, _CUT + _OTHER, _CONTROL * 2)).otherwise(text)


def postings(rows: DataFrame, fields: dict[int, str]) -> DataFrame:
    """(id, bit, pos, word, piece) of every word of the text columns that ``fields`` names by their bits.

    ``piece`` is the word with the gaps around it; a control character stands for the word on the other side of a gap.
    NULL texts have no words.
    """
    # The outer generator keeps Catalyst from computing what it takes apart a second time, for a filter in front of it.
    texts = rows.select("id", F.explode_outer(F.array(*[
        F.struct(F.lit(bit).alias("bit"), F.lower(text_or_empty(c)).alias("text")) for bit, c in fields.items()
    ])).alias("f")).select("id", "f.bit", "f.text").filter(F.rlike("text", F.lit(_WORD)))
    # Gaps between two words are doubled, so that each of the two keeps one when the text is cut in the middle.
    doubled = F.regexp_replace(
        _no_marks(F.col("text")), f"(?<={_WORD})({_NO_WORD}++)(?={_WORD})", f"$1{_OTHER}{_CUT}{_OTHER}$1"
    )
    # The text stays behind: what a generator passes on is copied to each of its rows.
    cut = texts.select("id", "bit", F.split(doubled, _CUT).alias("pieces"))
    pieces = cut.select("id", "bit", F.posexplode_outer("pieces").alias("pos", "piece"))
    return pieces.select("id", "bit", "pos", F.regexp_extract("piece", f"{_WORD}++", 0).alias("word"), "piece")


def _before(piece: Column) -> Column:
    """What stands before the word, with a letter for the word before that."""
    return F.replace(F.regexp_extract(piece, f"^{_NO_WORD}*+", 0), F.lit(_OTHER), F.lit("a"))


def _behind(piece: Column) -> Column:
    return F.replace(F.regexp_extract(piece, f"{_NO_WORD}*+$", 0), F.lit(_OTHER), F.lit("a"))


# ------------------------------------------------------------------ forms
_RUN = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("exact", T.BooleanType()),     # False: the word followed by digits
    T.StructField("j", T.IntegerType()),
    T.StructField("k", T.IntegerType()),         # words in the form
    T.StructField("gap", T.StringType()),        # how the gap before has to be: see ``_gap_holds``
    T.StructField("gap_text", T.StringType()),
    T.StructField("tail", T.StringType()),       # and the one behind
    T.StructField("tail_text", T.StringType()),
    T.StructField("lead_chars", T.IntegerType()),   # characters of the form in front of its first word
    T.StructField("trail_chars", T.IntegerType()),  # and behind its last
])
_ALNUM = re.compile(r"[^\W_]+")


def runs_of(form: str, mode: str) -> list[dict]:
    """The words of a form with what has to stand around each; a form without letter or digit has none."""
    form = form.lower().translate({ord(_CUT): _CONTROL, ord(_OTHER): _CONTROL})
    words: list[str] = []
    # What stands before, between and behind the words; in a loose form in pieces, with a separator between two.
    gaps: list[list[str]] = [[]]
    for part in form.split() if mode == LOOSE else [form]:
        around = _ALNUM.split(part)
        gaps[-1].append(around[0])
        words += _ALNUM.findall(part)
        gaps += [[g] for g in around[1:]]
    if not words:
        return []
    lead, trail = gaps[0], gaps[-1]
    pattern_of = lambda pieces: SEPARATOR.join(map(escape, pieces))
    rows = []
    for j, word in enumerate(words):
        last = j == len(words) - 1
        row = {"word": word, "exact": True, "j": j, "k": len(words), "gap": "any", "gap_text": "", "tail": "any", "tail_text": "",
               "lead_chars": len(lead[0]), "trail_chars": len(trail[-1])}
        if j:
            gap = gaps[j]
            if len(gap) == 1:
                row["gap"], row["gap_text"] = "equal", "a" + gap[0]
            elif gap == ["", ""]:
                row["gap"] = "separator"
            else:
                row["gap"], row["gap_text"] = "pattern", f"^a{pattern_of(gap)}$"
        elif len(lead) > 1:
            row["gap"], row["gap_text"] = "pattern", pattern_of(lead) + "$"
        elif lead != [""]:
            row["gap"], row["gap_text"] = "ends", lead[0]
        elif mode != LITERAL:
            row["gap"] = "free"
        if last and len(trail) > 1:
            row["tail"], row["tail_text"] = "pattern", "^" + pattern_of(trail)
        elif last and trail != [""]:
            row["tail"], row["tail_text"] = "starts", trail[0]
        elif last and mode != LITERAL:
            row["tail"] = "free"
        if last and trail == [""] and mode == LOOSE:
            rows += [{**row, "word": word + s} for s in SUFFIXES] + [{**row, "exact": False}]
        else:
            rows.append(row)
    return rows


@F.pandas_udf(T.ArrayType(_RUN))
def _runs(form: pd.Series, mode: pd.Series) -> pd.Series:
    return pd.Series([runs_of(f, m) for f, m in zip(form, mode)])


def _gap_holds(kind: Column, text: Column, before: Column) -> Column:
    return (
        F.when(kind == "any", True)
        .when(kind == "free", ~F.endswith(before, F.lit("_")))
        .when(kind == "separator", F.rlike(before, F.lit(f"^a{SEPARATOR}$")))
        .when(kind == "equal", before == text)
        .when(kind == "ends", F.endswith(before, text))
        .otherwise(F.rlike(before, text))
    )


def _tail_holds(kind: Column, text: Column, behind: Column) -> Column:
    return (
        F.when(kind == "any", True)
        .when(kind == "free", ~F.startswith(behind, F.lit("_")))
        .when(kind == "starts", F.startswith(behind, text))
        .otherwise(F.rlike(behind, text))
    )


def _keys(longest: int) -> Column:
    """What a word is looked up by: itself, and if it ends in digits all it could be without some of them (marked).

    Only as long as the longest word with digits behind it that is asked for.
    """
    word, size = F.col("word"), F.length("word")
    letters = F.length(F.regexp_replace(word, r"\p{Nd}+$", ""))
    first, last = F.greatest(letters, F.lit(1)), F.least(size - 1, F.lit(longest))
    end = F.substring(word, -1, 1)
    stems = F.transform(F.sequence(first, last), lambda n: F.concat(F.substring(word, F.lit(1), n), F.lit(_CUT)))
    in_digits = (end.between("0", "9") | (F.octet_length(end) > 1)) & F.rlike(word, F.lit(r"\p{Nd}$"))
    return F.when(in_digits & (first <= last), F.concat(F.array(word), stems)).otherwise(F.array(word))


def votes(index: DataFrame, forms: DataFrame) -> DataFrame:
    """(unit, id, bit, start, j, k, before, free_start, free_end, lead_chars, trail_chars): words that speak for a form.

    ``index`` are postings, ``forms`` has (unit, form, mode) with distinct units. A form stands at ``start`` if all of its k
    words, j from 0 on, speak for that. ``before`` and ``free_start`` (nothing of a word stands directly before the form)
    come with its first word, ``free_end`` with its last. Postings meet the words asked for in one join, whose small side
    Spark broadcasts if it is small by its size on disk.
    """
    runs = written(
        forms.select("unit", F.inline(_runs("form", "mode")))
        .withColumn("key", F.concat("word", F.when(F.col("exact"), "").otherwise(_CUT))),
        "form-words",
    )
    longest = runs.agg(F.max(F.when(~F.col("exact"), F.length("word")))).first()[0] or 0
    keyed = index.withColumn("key", F.explode_outer(_keys(longest))) if longest else index.withColumn("key", F.col("word"))
    # Computed once, behind the join: few words are asked for.
    around = F.explode_outer(F.array(F.struct(_before(F.col("piece")).alias("before"), _behind(F.col("piece")).alias("behind"))))
    met = (
        keyed.drop("word").join(runs.drop("word", "exact"), "key").withColumn("around", around)
        .select("*", "around.before", "around.behind")
        .filter(
            _gap_holds(F.col("gap"), F.col("gap_text"), F.col("before"))
            & _tail_holds(F.col("tail"), F.col("tail_text"), F.col("behind"))
        )
    )
    start_of = F.when(F.col("lead_chars") == 0, ~F.endswith("before", F.lit("_"))).otherwise(
        F.rlike(F.expr("substring(before, 1, length(before) - lead_chars)"), F.lit(r"(?:^|[^\p{L}\p{N}_])$")))
    end_of = F.when(F.col("trail_chars") == 0, ~F.startswith("behind", F.lit("_"))).otherwise(
        F.rlike(F.expr("substring(behind, trail_chars + 1)"), F.lit(r"^(?:$|[^\p{L}\p{N}_])")))
    return met.select(
        "unit", "id", "bit", (F.col("pos") - F.col("j")).alias("start"), "j", "k", "lead_chars", "trail_chars",
        F.when(F.col("j") == 0, F.col("before")).alias("before"),
        F.when(F.col("j") == 0, start_of).alias("free_start"),
        F.when(F.col("j") == F.col("k") - 1, end_of).alias("free_end"),
    )


def find_forms(index: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, unit) of the rows in which a form stands in some field."""
    return (
        votes(index, forms).groupBy("id", "unit", "bit", "start", "k").agg(F.count_distinct("j").alias("n"))
        .filter("n = k").select("id", "unit").distinct()
    )


def find_marks(rows: DataFrame, text: str, forms: DataFrame) -> DataFrame:
    """(id, unit) of the rows whose text has a form without any letter or digit, which stands in no index of words.

    Such forms are looked up by their first character, among the characters that a text has between its words.
    """
    others = F.split(F.regexp_replace(F.lower(text_or_empty(text)), f"{_WORD}++", ""), "")
    first = F.substring("form", 1, 1)
    asked = forms.filter(~F.rlike("form", F.lit(_WORD)) & (F.col("form") != "")).select("unit", "form", first.alias("mark"))
    texts = rows.select("id", F.lower(text_or_empty(text)).alias("text"), F.array_distinct(others).alias("marks"))
    met = texts.select("id", "text", F.explode_outer("marks").alias("mark")).join(asked, "mark")
    return met.filter(F.contains("text", F.col("form"))).select("id", "unit").distinct()
