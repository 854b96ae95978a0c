"""Scalar rules as Column expressions: dates, money, titles, labels, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions.text import (
    END, START, UNICODE, WORD, any_of, bind, clean_tags, col, contains_any, empty_to_null, squeeze, strip,
    text_or_empty,
)

NTZ = "timestamp_ntz"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


# ------------------------------------------------------------------ date and time
def _to_utc(ts: Column) -> Column:
    """TIMESTAMP -> wall clock in UTC, whatever the session time zone is."""
    return F.convert_timezone(None, F.lit("UTC"), ts.cast(NTZ))


def parse_iso(c: Column | str) -> Column:
    """ISO text -> UTC wall clock. Text without an offset is taken as it is."""
    s = F.replace(strip(c), F.lit("Z"), F.lit("+00:00"))
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    s = F.regexp_replace(s, r"([T ]\d{2}:?\d{2}.*[+-]\d{2})(\d{2})$", "$1:$2")
    # The cast wants seconds.
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=[+-]|$)", "$1:00")
    shaped = s.rlike(
        r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:[+-]\d{2}:\d{2})?)?$"
    )
    has_offset = s.rlike(r"[T ].*[+-]\d{2}:\d{2}$")
    return F.when(
        shaped & has_offset, _to_utc(s.try_cast("timestamp"))
    ).when(shaped & ~has_offset, s.try_cast(NTZ))


def parse_epoch(seconds: Column) -> Column:
    """Epoch seconds -> UTC wall clock; values outside years 1..9999 give NULL."""
    sane = seconds.between(-62135596800, 253402300799)
    whole_part = F.floor(seconds)
    micros = F.round((seconds - whole_part) * 1_000_000).cast("long")
    return F.when(
        sane,
        F.expr(_EPOCH)
        + F.make_dt_interval(
            F.floor(whole_part / 86400).cast("int"), F.lit(0), F.lit(0),
            ((whole_part % 86400 + 86400) % 86400 + micros / 1_000_000).cast("decimal(18,6)"),
        ),
    )


def parse_iso_or_epoch(value: Column) -> Column:
    """A VARIANT that holds either epoch seconds or ISO text."""
    kind = F.schema_of_variant(value)
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, parse_epoch(F.try_variant_get(value, "$", "double"))).when(
        kind == "STRING", parse_iso(F.try_variant_get(value, "$", "string"))
    )


def parse_feed_date(c: Column | str) -> Column:
    """RFC-822 date of an RSS item -> UTC wall clock."""
    s = F.regexp_replace(strip(c), r"^[A-Za-z]{3,9},?\s+", "")
    for name, offset in fv.FEED_ZONES.items():
        s = F.regexp_replace(s, rf"\s{name}$", f" {offset}")
    s = F.regexp_replace(s, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})( [+-]\d{4})$", "$1:00$2")
    return _to_utc(F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")))


def parse_relative(label: Column | str, now: Column) -> Column:
    """'Today', 'Yesterday', '3 days ago' ... relative to ``now``."""
    s = F.lower(strip(label))
    units = "|".join(fv.RELATIVE_UNIT_SECONDS)
    pattern = rf"(\d+)\s*({units})s?\b"
    seconds_per = F.lit(None).cast("long")
    unit = F.regexp_extract(s, pattern, 2)
    for name, seconds in fv.RELATIVE_UNIT_SECONDS.items():
        seconds_per = F.when(unit == name, F.lit(seconds).cast("long")).otherwise(seconds_per)
    total = F.regexp_extract(s, pattern, 1).try_cast("long") * seconds_per
    fresh = contains_any(s, ["just now", "just posted", "today"]) | (s == "new")
    return (
        F.when(fresh, now)
        .when(F.contains(s, F.lit("yesterday")), now - F.expr("interval 1 day"))
        .when(total.isNotNull(), now - F.make_dt_interval(days=F.floor(total / 86400).cast("int"),
                                                          secs=(total % 86400).cast("decimal(18,6)")))
    )


def relative_age(ts: Column | str, as_of: Column) -> Column:
    """'just now', '5m ago', '3h ago', '2d ago', '4mo ago', '1y ago'."""
    secs = F.timestamp_diff("SECOND", col(ts), as_of)
    minutes, hours, days = (F.floor(secs / n) for n in (60, 3600, 86400))
    return (
        F.when(col(ts).isNull(), "")
        .when(secs < 60, "just now")
        .when(minutes < 60, F.concat(minutes, F.lit("m ago")))
        .when(hours < 24, F.concat(hours, F.lit("h ago")))
        .when(days < 30, F.concat(days, F.lit("d ago")))
        .when(days < 365, F.concat(F.floor(days / 30), F.lit("mo ago")))
        .otherwise(F.concat(F.floor(days / 365), F.lit("y ago")))
    )


def iso_seconds(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


# ------------------------------------------------------------------ keys and links
def dedupe_key(url: Column | str) -> Column:
    return F.sha2(F.lower(strip(text_or_empty(url))), 256)


def safe_link(url: Column | str) -> Column:
    s = strip(text_or_empty(url))
    return F.when(F.lower(s).rlike("^https?://"), s).otherwise("#")


def without_query(href: Column) -> Column:
    return F.substring_index(href, "?", 1)


def last_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def id_before_dash(href: Column) -> Column:
    """The part of the last path segment in front of its first '-'."""
    slug = F.substring_index(href, "/", -1)
    return F.coalesce(empty_to_null(F.substring_index(slug, "-", 1)), slug)


# ------------------------------------------------------------------ contact e-mails
def extract_emails(
    text: Column | str,
    skip_domains: list[str] | None = None,
    skip_locals: list[str] | None = None,
    limit: int | None = None,
) -> Column:
    """Distinct contact addresses, noise removed, in order of appearance; the first ones with a limit."""
    domains = fv.EMAIL_SKIP_DOMAINS if skip_domains is None else skip_domains
    locals_ = fv.EMAIL_SKIP_LOCALS if skip_locals is None else skip_locals
    text = col(text)
    # The scan of a text without any '@' is skipped altogether.
    raw = F.when(
        F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(fv.EMAIL_PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    cleaned = F.transform(raw, lambda e: F.btrim(F.lower(e), F.lit(".")))

    def wanted(email: Column) -> Column:
        domain = F.substring(email, F.locate("@", email) + 1, F.length(email))
        keep = ~contains_any(F.substring_index(email, "@", 1), locals_)
        if domains:
            keep &= ~domain.rlike(rf"(?:^|\.){any_of(domains)}$")
        return keep & ~email.rlike(f"{any_of(fv.EMAIL_SKIP_ENDINGS)}$")

    found = F.array_distinct(F.filter(cleaned, wanted))
    return found if limit is None else F.slice(found, 1, limit)


# ------------------------------------------------------------------ titles and names
def company_and_position(title: Column) -> tuple[Column, Column]:
    """'Company: Position' at the first colon, when both sides say something."""
    left = strip(F.substring_index(title, ":", 1))
    right = strip(F.substring(title, F.locate(":", title) + 1, F.length(title)))
    both = F.contains(title, F.lit(":")) & (left != "") & (right != "")
    return F.when(both, left), F.when(both, right).otherwise(title)


def title_company_location(title: Column) -> tuple[Column, Column, Column]:
    """'Title - Company - Location', cut at most twice and from the right."""
    parts = F.split(title, " - ")
    n = F.size(parts)
    position = F.when(n <= 2, parts[0]).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(1))), " - ")
    )
    company = F.when(n == 2, F.try_element_at(parts, F.lit(2))).when(
        n >= 3, F.try_element_at(parts, F.lit(-2))
    )
    location = F.when(n >= 3, F.try_element_at(parts, F.lit(-1)))
    return strip(position), strip(company), strip(location)


def _slug_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(text)), "[^a-z0-9]+"), lambda t: t != "")


def company_from_slug(slug: Column, title: Column) -> Column:
    """What is left of '<company>-<title>-<id>' after peeling id and title off its end.

    Both inputs are expected with entities already resolved.
    """
    strings = "array<string>"
    all_tokens = _slug_tokens(slug)
    has_id = F.try_element_at(all_tokens, F.lit(-1)).rlike(r"^\d+$")
    tokens = F.when(
        has_id, F.slice(all_tokens, F.lit(1), F.greatest(F.size(all_tokens) - 1, F.lit(0)))
    ).otherwise(all_tokens)
    peelable = F.concat(_slug_tokens(title), F.array(*map(F.lit, fv.SLUG_NOISE)).cast(strings))
    # Position of the last token that does not belong to the title.
    kept = F.array_max(
        F.transform(tokens, lambda t, i: F.when(~F.array_contains(peelable, t), i + 1).otherwise(0))
    )
    company = F.slice(tokens, F.lit(1), F.coalesce(kept, F.lit(0)))
    shown = F.transform(
        company,
        lambda t: F.when(t.isin(fv.SLUG_ACRONYMS), F.upper(t)).otherwise(F.initcap(t)),
    )
    plausible = F.size(company).between(1, 5) & F.exists(
        company, lambda t: ~t.isin(fv.SLUG_NON_COMPANY)
    )
    return F.when(plausible, F.array_join(shown, " "))


def city_label(name: Column, state: Column) -> Column:
    name, state = strip(text_or_empty(name)), strip(text_or_empty(state))
    with_state = (state != "") & (F.upper(state) != "REMOTE") & (F.lower(state) != F.lower(name))
    return F.when(name != "", F.when(with_state, F.concat(name, F.lit(", "), state)).otherwise(name))


def remote_label(status: Column, hybrid: Column) -> Column:
    shown = F.initcap(F.replace(F.lower(status), F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(hybrid, F.lit(False)), "Hybrid").when(
        (text_or_empty(status) != "") & (F.upper(status) != "NOT_REMOTE"), shown
    )


# ------------------------------------------------------------------ money
def dollar_range(low: Column, high: Column) -> Column:
    """'$80,000 - $120,000', '$80,000+' or NULL."""
    low, high = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    lo, hi = F.format_number(low, 0), F.format_number(high, 0)
    return F.when(
        low.isNotNull() & high.isNotNull(), F.concat(F.lit("$"), lo, F.lit(" - $"), hi)
    ).when(low.isNotNull(), F.concat(F.lit("$"), lo, F.lit("+")))


def currency_range(currency: Column, low: Column, high: Column) -> Column:
    """'EUR 50000-70000/yr', one-sided when only one end is known. Ends are text."""
    low, high = (F.when(~text_or_empty(x).isin("", "0", "0.0", "false"), x) for x in (low, high))
    span = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("-"), high)).otherwise(
        F.coalesce(low, high)
    )
    return strip(F.concat(strip(text_or_empty(currency)), F.lit(" "), span, F.lit("/yr")))


def compact_money(amount: Column) -> Column:
    """$1.5M / $180k / $900; NULL unless positive."""
    millions = amount / F.lit(1_000_000.0)
    # One decimal of the stored binary value, ties to even: the fraction of a double is
    # exact, so it can be compared as an integer.
    scaled = ((millions - F.floor(millions)) * F.lit(float(2**53))).cast("long") * 10
    tenth = F.shiftright(scaled, 53)
    rest = scaled - tenth * F.lit(2**53)
    half = F.lit(2**52)
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    tenths = F.floor(millions) * 10 + tenth + up.cast("long")
    in_millions = F.when(
        tenths % 10 == 0, F.concat(F.lit("$"), F.floor(tenths / 10), F.lit("M"))
    ).otherwise(
        F.concat(F.lit("$"), F.floor(tenths / 10), F.lit("."), tenths % 10, F.lit("M"))
    )
    thousands = F.bround(amount / F.lit(1000.0), 0).cast("long")
    return (
        F.when(amount >= 1_000_000, in_millions)
        .when(amount >= 1_000, F.concat(F.lit("$"), thousands, F.lit("k")))
        .when(amount > 0, F.concat(F.lit("$"), amount))
    )


def compact_range(low: Column, high: Column) -> Column:
    lo, hi = compact_money(low), compact_money(high)
    return F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(lo, F.lit(" – "), hi)).otherwise(
        F.coalesce(lo, hi)
    )


def salary_in_text(text: Column) -> Column:
    return empty_to_null(squeeze(F.regexp_extract(text_or_empty(text), fv.SALARY_TEXT_PATTERN, 0)))


def salary_chip(text: Column) -> Column:
    return empty_to_null(squeeze(F.regexp_extract(text_or_empty(text), fv.SALARY_CHIP_PATTERN, 0)))


# ------------------------------------------------------------------ locations
def location_in_text(text: Column) -> Column:
    line = F.regexp_extract(text_or_empty(text), fv.LOCATION_LINE_PATTERN, 1)
    line = F.regexp_replace(line, r"\s+", " ")
    line = F.regexp_replace(line, fv.LOCATION_STOP_PATTERN, "")
    return empty_to_null(F.btrim(line, F.lit(" .;,")))


def remote_from(card_text: Column) -> Column:
    place = F.regexp_extract(card_text, fv.REMOTE_FROM_PATTERN, 1)
    place = F.btrim(F.regexp_replace(place, r"\s+", " "), F.lit(" ·,"))
    return F.when(card_text.rlike(fv.REMOTE_FROM_PATTERN), place).when(
        F.contains(card_text, F.lit("Remote")), "Remote"
    )


def card_job_type(card_text: Column) -> Column:
    lowered = F.lower(card_text)
    found = F.lit(None).cast("string")
    for label in reversed(fv.CARD_JOB_TYPES):
        found = F.when(F.contains(lowered, F.lit(label)), label.title()).otherwise(found)
    return found


# ------------------------------------------------------------------ listing facts
def required_years(title: Column | str, description: Column | str) -> Column:
    """Highest number of years of experience the listing asks for, or NULL."""
    text = F.lower(F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(description)))

    def highest(t: Column) -> Column:
        found = F.concat(
            F.regexp_extract_all(t, F.lit(UNICODE + fv.YEARS_BEFORE), F.lit(1)),
            F.regexp_extract_all(t, F.lit(UNICODE + fv.YEARS_AFTER), F.lit(1)),
        )
        numbers = F.transform(found, lambda n: n.try_cast("int"))
        plausible = F.filter(numbers, lambda n: n.between(1, fv.MAX_PLAUSIBLE_YEARS))
        # Both patterns need the letters 'exp' somewhere; most texts do not have them.
        return F.when(F.contains(t, F.lit("exp")), F.array_max(plausible))

    return bind(text, highest)


def score_band(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when(s.isNull(), "unscored").when(s >= fv.HIGH_SCORE, "high")
        .when(s >= fv.MID_SCORE, "mid").otherwise("low")
    )


def seniority(text: Column) -> Column:
    # A word edge after the match: after a letter nothing wordy may follow, after the dot
    # of an abbreviation something wordy has to.
    edge = rf"(?:(?<={WORD}){END}|(?<!{WORD})(?={WORD}))"

    def has(words: str) -> Column:
        return text.rlike(rf"(?iu){START}(?:{words}){edge}")

    return (
        F.when(has(fv.SENIORITY_LEAD), "lead")
        .when(has(fv.SENIORITY_SENIOR), "senior")
        .when(has(fv.SENIORITY_JUNIOR), "junior")
        .otherwise("mid")
    )


def csv_safe(c: Column | str) -> Column:
    """Text with a leading ' in front of characters a spreadsheet would execute."""
    s = text_or_empty(col(c).cast("string"))
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def alert_text(
    score: Column, title: Column, company: Column, reason: Column, url: Column, max_chars: int | None = None
) -> Column:
    """The message of an alert; with ``max_chars`` (what its receiver takes) a longer one ends in an ellipsis."""
    head = F.concat(F.lit("⭐ "), F.coalesce(score.cast("string"), F.lit("?")), F.lit("/10 — "), title)
    text = F.concat_ws("\n", head, empty_to_null(company), empty_to_null(reason), url)
    if max_chars is None:
        return text
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars - 1), F.lit("…"))
    ).otherwise(text)


# ------------------------------------------------------------------ scoring rows
def scoring_prompt(profile: Column, description_chars: int | None = None) -> Column:
    """The text a scorer gets for one listing row (columns by name), with the whole description unless limited."""
    description = text_or_empty("description")
    if description_chars is not None:
        description = F.substring(description, 1, description_chars)
    tags = F.coalesce(empty_to_null(F.array_join("tags", ", ")), F.lit("none"))
    return F.concat(
        F.lit("MY PROFILE:\n"), profile,
        F.lit("\n\nJOB TO EVALUATE:\nTitle: "), F.col("title"),
        F.lit("\nCompany: "), F.coalesce(empty_to_null("company"), F.lit("Unknown")),
        F.lit("\nSource: "), F.col("source"),
        F.lit("\nLocation: "), F.coalesce(empty_to_null("location"), F.lit("Not specified")),
        F.lit("\nBudget: "), F.coalesce(empty_to_null("budget"), F.lit("Not specified")),
        F.lit("\nTags: "), tags,
        F.lit("\n\nDescription:\n"),
        description,
        F.lit("\n"),
    )


def parse_reply(reply: Column | str) -> Column:
    """Scorer reply -> struct(score, reason, proposal, error); a bad reply keeps score NULL."""
    body = F.regexp_extract(text_or_empty(reply), r"(?s)\{.*\}", 0)

    def read(data: Column) -> Column:
        raw = F.try_variant_get(data, "$.score", "string")
        number = raw.try_cast("double")
        finite = ~number.isin(float("inf"), float("-inf")) & ~F.isnan(number)
        score = F.greatest(F.lit(0), F.least(F.lit(10), F.bround(number, 0))).cast("int")
        error = (
            F.when(data.isNull(), "not json")
            .when(raw.isNull(), "score missing")
            .when(~F.coalesce(finite, F.lit(False)), "score invalid")
        )
        text = lambda name: F.when(
            finite, strip(text_or_empty(F.try_variant_get(data, f"$.{name}", "string")))
        )
        return F.struct(
            F.when(finite, score).alias("score"), text("reason").alias("reason"),
            text("proposal").alias("proposal"), error.alias("error"),
        )

    return bind(F.try_parse_json(empty_to_null(body)), read)


def model_list(value: Column, cap: int | None = None) -> Column:
    """A VARIANT holding a list, or text separated by , ; or line breaks -> clean list."""
    items = F.coalesce(
        F.try_variant_get(value, "$", "array<string>"),
        F.split(F.try_variant_get(value, "$", "string"), "[,\n;]+"),
        F.array().cast("array<string>"),
    )
    lowered = F.transform(clean_tags(items), lambda x: F.lower(x))
    return lowered if cap is None else F.slice(lowered, 1, cap)
