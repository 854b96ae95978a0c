"""Personal data: patterns propose spans, checksums confirm them, context words change their score.

All on built-in functions. A kind's spans are found by cutting the text at the pattern (``split``) and taking the
matches themselves (``regexp_extract_all``): both walk the same leftmost, non-overlapping matches, so gap and match
lengths in turn give every position in code points. The patterns start only where a run of their characters starts (or
where the match before ended) and take runs without giving back, so their time is linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import query, table

# What the base kinds match.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# The same matches in linear time.
_LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE_PATTERNS["phone"],
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A character without which a text cannot have the kind: those texts are not searched.
_NEEDS = {"email": "@", "phone": "+"}
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]

#: Words near a span that speak for its kind (lower case), and words that speak against it.
CONTEXT = {
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "passport", "id", "ausweis", "dni"),
}
AGAINST = ("example", "test", "sample", "order", "invoice", "isbn", "serial")
#: Context is read so many characters before and after a span, as far as the next span proposed for the same kind.
NEAR = 40
#: The score of a span in tenths: a pattern gives PATTERN, a passed checksum CHECKSUM, words nearby add or take NEARBY.
#: Spans of the kinds beyond the base count from LEAST on.
LEAST, PATTERN, CHECKSUM, NEARBY = 5, 3, 4, 3


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda s, i: s + F.element_at(
            F.when((F.length(digits) - i) % 2 == 1, F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]))
            .otherwise(F.array(*[F.lit(x) for x in range(10)])),
            digits.substr(i, F.lit(1)).cast("int") + 1,
        ),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces passes: its first four characters last, letters as 10 to 35, the rest by 97 is 1."""
    moved = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda r, c: (r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97,
    )
    return rest == 1


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        digits = digits_of(match)
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(match)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


_SPANS = "array<struct<start:int,rank:int,end:int,score:int>>"


def _score(kind: str, context: Column) -> Column:
    near = lambda words: context.rlike(r"\b(?:" + "|".join(words) + r")\b")
    score = F.lit(PATTERN + (CHECKSUM if kind in ("card", "iban") else 0))
    if kind in CONTEXT:
        score = score + F.when(near(CONTEXT[kind]), NEARBY).otherwise(0) - F.when(near(AGAINST), NEARBY).otherwise(0)
    return score


def spans_of(text: Column, kind: str) -> Column:
    """ARRAY<STRUCT<start, rank, end, score>> of a kind's confirmed spans, by start; rank is the kind's place in KINDS."""
    pattern = _LINEAR[kind]
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))

    def walk(parts: Column) -> Column:
        matches, gaps = parts["matches"], parts["gaps"]

        def take(state: Column, i: Column) -> Column:
            match, before, after = F.element_at(matches, i), F.element_at(gaps, i), F.element_at(gaps, i + 1)
            start = state["at"] + F.length(before)
            end = start + F.length(match)
            context = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
            score = _score(kind, context)
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), score.alias("score"))
            good = _passes(kind, match) if kind in BASE else _passes(kind, match) & (score >= LEAST)
            return F.struct(
                end.alias("at"), F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found")
            )

        numbers = F.when(F.size(matches) > 0, F.sequence(F.lit(1), F.size(matches))).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
        return F.aggregate(numbers, start, take)["found"]

    # One element, so that the cut is a variable of the lambda: else every step would cut the text again.
    found = F.element_at(F.transform(F.array(cut), walk), 1)
    needed = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(needed, found).otherwise(F.array().cast(_SPANS))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column pii: ARRAY<STRUCT<start, rank, end, score>>, by start and then by kind.

    Positions are code points, the end is exclusive. The base kinds' spans are all there; a span of another kind is if
    its checksum passes and its score reaches LEAST. Spans of different kinds may overlap. A null or empty text has an
    empty array; repeated rows get the same one each; a column pii that was there before is replaced. No row moves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.array_sort(F.concat(*[spans_of(text, kind) for kind in KINDS])))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def put(state: Column, s: Column) -> Column:
        kept = text.substr(state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(state["done"], kept, F.lit("["), F.element_at(names, s["rank"] + 1), F.lit("]")).alias("done"),
        ))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    return F.aggregate(spans, start, put, lambda s: F.concat(s["done"], text.substr(s["at"] + 1, F.length(text))))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    is_base = lambda s: s["rank"] < len(BASE)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return docs.select(
        "doc_id", *[count(kind) for kind in BASE], F.sha2(joined(F.filter("pii", is_base)), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans")
    )
