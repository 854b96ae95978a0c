"""Sources that answer with HTML.

Bodies are parsed once into node lists; cards and their parts are then picked by expressions
over the nodes of one row. Only the small result structs are exploded, so a page is never
copied per listing. Text clean-up happens on ordinary columns after that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions import html as h
from listwright.functions import scalars as s
from listwright.functions.text import (
    bind, clean_tags, contains_any, empty_to_null, joined, squeeze, strip, text_or_empty,
)
from listwright.operators.dedupe import first_per_key, top_per_key
from listwright.sources.landing import as_raw, good_responses, item_ord


def _pages(landing: DataFrame, source: str) -> DataFrame:
    return good_responses(landing, source).select(
        "cycle_id", "feed_ord", "feed_key", "fetched_at", "body", h.html_nodes("body").alias("nodes")
    )


def _explode(pages: DataFrame, structs: Column) -> DataFrame:
    return pages.select(
        "cycle_id", "feed_ord", "feed_key", "fetched_at", F.posexplode(structs).alias("pos", "c")
    ).select("cycle_id", "feed_ord", "feed_key", "fetched_at", "pos", "c.*")


def _nodes() -> Column:
    return F.col("nodes")


def _links(pattern: str) -> Column:
    """All anchors whose href matches, in document order."""
    return F.filter(_nodes(), lambda x: _is_link(x, pattern))


def _is_link(x: Column, pattern: str) -> Column:
    return (x["tag"] == "a") & F.coalesce(x["href"].rlike(pattern), F.lit(False))


def _is(tag: str, cls: str | None = None) -> Callable[[Column], Column]:
    return lambda x: (x["tag"] == tag) & (h.has_class(x, cls) if cls else F.lit(True))


def _nearest(node: Column, *tags: str) -> Column:
    """Closest ancestor with one of the tags, else NULL."""
    return h.last(F.filter(h.ancestors(_nodes(), node), lambda x: x["tag"].isin(*tags)))


def _lines(scope: Column) -> Column:
    """Stripped, non-blank lines of the text below a node."""
    text = h.node_text(_nodes(), scope, "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")


def _absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def _first_wins(df: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """First row per key; with a cap, only the first rows of the cycle."""
    rows = first_per_key(df, ["cycle_id", key], ["feed_ord", "feed_key", "pos"])
    return rows if cap is None else top_per_key(rows, ["cycle_id"], ["feed_ord", "feed_key", "pos"], cap)


# ------------------------------------------------------------------ offer cards
def jobgether(landing: DataFrame, cap: int | None = None) -> DataFrame:
    nodes = _nodes()

    def card_of(a: Column, offer_at: Column) -> Column:
        """Widest of the ten closest ancestors that holds this offer and no other."""
        above = F.filter(h.ancestors(nodes, a), lambda x: x["depth"] >= a["depth"] - 10)
        alone = lambda x: F.size(
            F.filter(offer_at, lambda i: (i >= x["idx"]) & (i <= x["last"]))
        ) == 1
        return bind(above, lambda up: F.coalesce(h.first(F.filter(up, alone)), h.last(up)))

    def chip_texts(card: Column) -> Column:
        """(href, chip) of the links inside the card that show a chip."""
        inside = h.select(nodes, card, lambda x: _is_link(x, "^/remote-jobs/"))
        return F.transform(
            inside,
            lambda x: F.struct(
                x["href"].alias("href"),
                h.node_text(nodes, h.find(nodes, x, _is("div", "line-clamp-1"))).alias("chip"),
            ),
        )

    with_card = bind(
        _links(fv.OFFER_HREF),
        lambda offers: bind(
            F.transform(offers, lambda x: x["idx"]),
            lambda offer_at: F.transform(
                offers, lambda a: F.struct(a.alias("a"), card_of(a, offer_at).alias("card"))
            ),
        ),
    )
    cards = F.transform(
        with_card,
        lambda c: F.struct(
            s.without_query(c["a"]["href"]).alias("href"),
            strip(F.coalesce(empty_to_null(c["a"]["title"]), h.node_text(nodes, c["a"]))).alias("title"),
            h.node_text(
                nodes, h.find(nodes, c["card"], lambda x: _is_link(x, fv.OFFER_COMPANY_HREF))
            ).alias("company"),
            h.node_text(nodes, c["card"]).alias("text"),
            chip_texts(c["card"]).alias("chips"),
            h.node_text(
                nodes,
                h.find(
                    nodes, F.element_at(nodes, c["a"]["parent"] + 1),
                    lambda x: (x["tag"] == "div") & (x["idx"] > c["a"]["last"])
                    & (x["parent"] == c["a"]["parent"]),
                ),
            ).alias("age"),
        ),
    )
    rows = _explode(_pages(landing, "jobgether"), cards).filter("href <> '' and title <> ''")
    rows = _first_wins(rows, "href", cap)

    skills = F.transform(
        F.filter(
            F.col("chips"),
            lambda c: ~c["href"].rlike(fv.OFFER_COMPANY_HREF)
            & ~F.substring_index(c["href"], "/", -1).isin(fv.CHIP_NON_TAG_SLUGS)
            & F.length(c["chip"]).between(1, 40)
            & ~F.lower(c["chip"]).isin(fv.CHIP_NOT_A_SKILL),
        ),
        lambda c: c["chip"],
    )
    rows = rows.select(
        "*", s.remote_from(F.col("text")).alias("location"),
        s.card_job_type(F.col("text")).alias("job_type"), s.salary_chip(F.col("text")).alias("salary"),
    ).withColumn("tags", clean_tags(F.concat(skills, F.array("job_type"))))
    age = F.when(F.length("age") <= 30, F.col("age"))
    c = F.col
    return as_raw(
        rows, "jobgether",
        external_id=s.id_before_dash(c("href")),
        url=F.concat(F.lit(fv.BASE_URLS["jobgether"]), c("href")),
        title=c("title"),
        company=c("company"),
        description=joined(" · ", c("title"), c("company"), c("location"), c("job_type"),
                           c("salary"), F.array_join("tags", ", ")),
        tags=c("tags"),
        budget=c("salary"),
        location=c("location"),
        posted_at=s.parse_relative(age, c("fetched_at")),
        item_ord=item_ord(c("pos")),
    )


# ------------------------------------------------------------------ start-up cards
_SLOTS = "struct<age string, salary string, experience string, job_type string, location string>"


def classify_chips(chips: Column) -> Column:
    """Put each chip into the first slot that is free and that it fits; first chip wins."""

    def step(slots: Column, chip: Column) -> Column:
        low = F.lower(chip)
        fits = {
            "age": F.contains(low, F.lit("ago")) | low.isin("today", "just now"),
            "salary": contains_any(chip, ["$", "€", "£"]),
            "experience": low.rlike(r"\byears?\b.*\bexp"),
            "job_type": low.isin(fv.ROW_JOB_TYPES),
            "location": contains_any(low, ["remote", "on-site", "hybrid"]),
        }
        taken = F.lit(False)
        out = []
        for slot, fit in fits.items():
            here = ~taken & slots[slot].isNull() & fit
            out.append(F.when(here, chip).otherwise(slots[slot]).alias(slot))
            taken = taken | here
        return F.struct(*out)

    return F.aggregate(chips, F.from_json(F.lit("{}"), _SLOTS), step)


def wellfound(landing: DataFrame, cap: int | None = None) -> DataFrame:
    nodes = _nodes()

    def jobs_in(x: Column, job_at: Column) -> Column:
        return F.size(F.filter(job_at, lambda i: (i > x["idx"]) & (i <= x["last"])))

    headers = F.filter(
        nodes, lambda x: (x["tag"] == "div") & F.coalesce(x["testid"] == "startup-header", F.lit(False))
    )

    def card_of(header: Column, job_at: Column) -> Column:
        near = F.filter(h.ancestors(nodes, header), lambda x: x["depth"] >= header["depth"] - 6)
        return h.last(F.filter(near, lambda x: jobs_in(x, job_at) > 0))

    def row_of(a: Column, job_at: Column) -> Column:
        near = F.filter(h.ancestors(nodes, a), lambda x: x["depth"] >= a["depth"] - 4)
        return F.coalesce(h.first(F.filter(near, lambda x: jobs_in(x, job_at) <= 1)), a)

    def chips_of(row: Column) -> Column:
        """Texts of spans and divs, innermost first."""
        boxes = h.select(nodes, row, lambda x: x["tag"].isin("span", "div"))
        texts = F.transform(F.reverse(boxes), lambda x: squeeze(h.node_text(nodes, x)))
        return F.filter(texts, lambda t: F.length(t).between(1, 120))

    def company_of(header: Column) -> Column:
        link = h.find(nodes, header, lambda x: _is_link(x, fv.STARTUP_COMPANY_HREF))
        heading = h.find(nodes, header, lambda x: x["tag"].isin("h2", "h3"))
        return F.coalesce(empty_to_null(h.node_text(nodes, link)), h.node_text(nodes, heading))

    def tagline_of(header: Column) -> Column:
        spans = h.select(nodes, header, lambda x: x["tag"] == "span")
        return h.first(
            F.filter(
                F.transform(spans, lambda x: h.node_text(nodes, x)),
                lambda t: F.length(t).between(16, 180) & ~F.contains(t, F.lit("Employees")),
            )
        )

    def listing(a: Column, card: Column, job_at: Column) -> Column:
        return F.struct(
            s.without_query(a["href"]).alias("href"),
            h.node_text(nodes, a).alias("title"),
            card["company"].alias("company"),
            card["tagline"].alias("tagline"),
            bind(row_of(a, job_at), lambda row: classify_chips(chips_of(row))).alias("slots"),
        )

    def cards(job_at: Column) -> Column:
        return F.transform(
            headers,
            lambda x: F.struct(
                card_of(x, job_at).alias("card"), company_of(x).alias("company"),
                tagline_of(x).alias("tagline"),
            ),
        )

    listings = bind(
        F.transform(_links(fv.STARTUP_JOB_HREF), lambda x: x["idx"]),
        lambda job_at: F.flatten(
            F.transform(
                cards(job_at),
                lambda c: F.transform(
                    h.select(nodes, c["card"], lambda x: _is_link(x, fv.STARTUP_JOB_HREF)),
                    lambda a: listing(a, c, job_at),
                ),
            )
        ),
    )
    pages = _pages(landing.filter(~contains_any(F.col("body"), fv.BLOCK_MARKERS)), "wellfound")
    rows = _explode(pages, listings).filter("href <> '' and title <> ''")
    rows = _first_wins(rows, "href", cap).select("*", "slots.*")
    c = F.col
    return as_raw(
        rows, "wellfound",
        external_id=s.id_before_dash(F.regexp_replace("href", "/+$", "")),
        url=F.concat(F.lit(fv.BASE_URLS["wellfound"]), c("href")),
        title=c("title"),
        company=c("company"),
        description=joined(" · ", c("title"), c("company"), c("tagline"), c("location"),
                           c("job_type"), c("salary"), c("experience")),
        tags=clean_tags(F.array("job_type", "experience")),
        budget=c("salary"),
        location=c("location"),
        posted_at=s.parse_relative(c("age"), c("fetched_at")),
        item_ord=item_ord(c("pos")),
    )


# ------------------------------------------------------------------ alert mails
def linkedin_email(landing: DataFrame) -> DataFrame:
    nodes = _nodes()
    links = F.transform(
        _links(fv.MAIL_JOB_HREF),
        lambda a: F.struct(
            F.regexp_extract(a["href"], fv.MAIL_JOB_HREF, 1).alias("job_id"),
            h.node_text(nodes, a).alias("title"),
            h.node_text(nodes, F.coalesce(_nearest(a, "td", "div", "table"), a), "\n").alias("context"),
        ),
    )
    rows = _explode(_pages(landing, "linkedin_email"), links).filter(
        (F.length("title") >= 3) & ~F.lower("title").isin(fv.MAIL_SKIP_TITLES)
    )
    rows = _first_wins(rows, "job_id")
    lines = F.filter(
        F.transform(F.split("context", "\n"), lambda x: strip(x)), lambda x: x != ""
    )
    rows = rows.withColumn("lines", lines)
    # The line after the first line that is the title, unless it repeats the title.
    at = F.array_position(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0))), F.col("title"))
    after = F.when(at > 0, F.try_element_at("lines", (at + 1).cast("int")))
    company = F.when(
        F.lower(after) != F.lower("title"),
        empty_to_null(strip(F.substring_index(F.substring_index(after, "·", 1), "•", 1))),
    )
    c = F.col
    return as_raw(
        rows, "linkedin_email",
        external_id=c("job_id"),
        url=F.concat(F.lit(fv.BASE_URLS["linkedin"]), c("job_id"), F.lit("/")),
        title=c("title"),
        company=company,
        description=F.coalesce(empty_to_null("context"), c("title")),
        item_ord=item_ord(c("pos")),
    )


# ------------------------------------------------------------------ guest search
def linkedin_web(landing: DataFrame, cap: int | None = None) -> DataFrame:
    nodes = _nodes()

    def inside_of(x: Column, tag: str, cls: str | None = None) -> Column:
        return F.exists(h.ancestors(nodes, x), _is(tag, cls))

    shapes = [
        F.filter(nodes, lambda x: _is("div", "base-card")(x) & inside_of(x, "li")),
        F.filter(nodes, _is("div", "base-search-card")),
        F.filter(nodes, lambda x: _is("li")(x) & inside_of(x, "ul", "jobs-search__results-list")),
    ]
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in shapes])
    any_tag = lambda cls: (lambda x: h.has_class(x, cls))

    def pick(card: Column, *wanted: Callable[[Column], Column]) -> Column:
        return F.coalesce(*[h.find(nodes, card, w) for w in wanted])

    def subtitle(card: Column) -> Column:
        heading = h.find(nodes, card, _is("h4", "base-search-card__subtitle"))
        linked = h.find(
            nodes, card, lambda x: _is("a")(x) & inside_of(x, "h4", "base-search-card__subtitle")
        )
        return F.coalesce(linked, heading, h.find(nodes, card, any_tag("base-search-card__subtitle")))

    cards = F.transform(
        found,
        lambda card: F.struct(
            strip(
                s.without_query(
                    pick(
                        card, _is("a", "base-card__full-link"), _is("a", "base-search-card__title"),
                        lambda x: _is_link(x, "/jobs/view/"),
                    )["href"]
                )
            ).alias("href"),
            h.node_text(
                nodes, pick(card, _is("h3", "base-search-card__title"), any_tag("base-search-card__title"))
            ).alias("title"),
            h.node_text(nodes, subtitle(card)).alias("company"),
            h.node_text(
                nodes,
                pick(card, _is("span", "job-search-card__location"), any_tag("job-search-card__location")),
            ).alias("location"),
            h.find(nodes, card, _is("time"))["datetime"].alias("time"),
        ),
    )
    rows = _explode(_pages(landing, "linkedin_web"), cards).filter("href <> '' and title <> ''")
    rows = _first_wins(rows, "href", cap)
    c = F.col
    return as_raw(
        rows, "linkedin_web",
        external_id=F.coalesce(empty_to_null(s.last_segment(c("href"))), c("href")),
        url=c("href"),
        title=c("title"),
        company=c("company"),
        description=joined(" · ", c("title"), c("company"), c("location")),
        location=c("location"),
        posted_at=s.parse_iso("time"),
        item_ord=item_ord(c("pos")),
    )


# ------------------------------------------------------------------ article cards
def mustakbil(landing: DataFrame) -> DataFrame:
    nodes = _nodes()

    def text(scope: Column) -> Column:
        """Text without the names of icons."""
        pieces = bind(
            h.select(nodes, scope, _is("i", "icon")),
            lambda icons: h.select(
                nodes, scope,
                lambda x: (x["tag"] == "#text") & ~F.exists(icons, lambda i: h.inside(x, i)),
            ),
        )
        stripped = F.filter(F.transform(pieces, lambda x: strip(x["text"])), lambda t: t != "")
        return F.array_join(stripped, " ")

    part = lambda card, tag, cls: h.find(nodes, card, _is(tag, cls))
    cards = F.transform(
        F.filter(nodes, _is("article")),
        lambda card: F.struct(
            part(card, "a", "jl-title__link")["href"].alias("href"),
            text(part(card, "a", "jl-title__link")).alias("title"),
            text(part(card, "span", "jl-company__name")).alias("company"),
            text(part(card, "p", "jl-location")).alias("location"),
            text(part(card, "span", "jl-salary")).alias("salary"),
            text(part(card, "p", "jl-desc")).alias("summary"),
            F.filter(
                F.transform(h.select(nodes, card, _is("span", "jl-chip")), text),
                lambda t: t != "",
            ).alias("chips"),
        ),
    )
    rows = _explode(_pages(landing, "mustakbil"), cards).filter("href <> '' and title <> ''")
    rows = rows.withColumn("url", _absolute(F.col("href"), fv.BASE_URLS["mustakbil"]))
    # Written so that the years-of-experience rule can read it.
    facts = F.transform(
        "chips",
        lambda t: F.when(t.rlike(fv.YEARS_CHIP), F.concat(F.lit("Experience: "), t)).otherwise(t),
    )
    c = F.col
    return as_raw(
        rows, "mustakbil",
        external_id=s.last_segment(c("url")),
        url=c("url"),
        title=c("title"),
        company=empty_to_null("company"),
        description=F.concat_ws(" · ", empty_to_null("summary"), facts),
        tags=c("chips"),
        budget=empty_to_null("salary"),
        location=F.coalesce(empty_to_null("location"), F.lit("Pakistan")),
        item_ord=item_ord(c("pos")),
    )


# ------------------------------------------------------------------ plain link lists
def _link_rows(landing: DataFrame, source: str, structs: Column, cap: int | None) -> DataFrame:
    rows = _explode(_pages(landing, source), structs)
    rows = rows.withColumn(
        "url", s.without_query(_absolute(F.col("href"), fv.BASE_URLS[source]))
    ).filter(F.length("title") >= 4)
    return _first_wins(rows, "url", cap)


def lines_after(lines: Column, title: Column) -> Column:
    """Up to three lines after the run of at most eight lines that spells the title."""
    n = F.size(lines)
    runs = F.flatten(
        F.transform(
            F.when(n > 0, F.sequence(F.lit(1), n)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(8), n - i + 1)),
                lambda k: F.when(
                    F.array_join(F.slice(lines, i, k), " ") == title, i + k
                ),
            ),
        )
    )
    start = h.first(F.filter(runs, lambda x: x.isNotNull()))
    return F.coalesce(F.slice(lines, start, F.lit(3)), F.array().cast("array<string>"))


def rozee(landing: DataFrame, cap: int | None = None) -> DataFrame:
    nodes = _nodes()
    links = F.filter(
        nodes, lambda x: _is_link(x, fv.ROZEE_HREF) | _is_link(x, fv.ROZEE_RELATIVE_HREF)
    )
    structs = F.transform(
        links,
        lambda a: F.struct(
            a["href"].alias("href"),
            h.node_text(nodes, a).alias("title"),
            _lines(_nearest(a, "div", "li", "article")).alias("lines"),
        ),
    )
    rows = _link_rows(landing, "rozee", structs, cap)
    no_lines = F.array().cast("array<string>")
    rows = rows.withColumn("lines", F.coalesce("lines", no_lines))
    rows = rows.withColumn("after", lines_after(F.col("lines"), F.col("title")))
    next_line = h.first(F.col("after"))
    places = F.filter(
        F.when(F.size("after") > 0, F.col("after")).otherwise(F.col("lines")),
        lambda x: F.contains(F.lower(x), F.lit("pakistan")) | x.rlike(fv.ROZEE_CITY),
    )
    c = F.col
    return as_raw(
        rows, "rozee",
        external_id=c("url"),
        url=c("url"),
        title=c("title"),
        company=F.when(~next_line.rlike(fv.ROZEE_NOT_COMPANY), empty_to_null(next_line)),
        description=c("title"),
        location=F.coalesce(h.first(places), F.lit("Pakistan")),
        item_ord=item_ord(c("pos")),
    )


def bayt(landing: DataFrame, cap: int | None = None) -> DataFrame:
    nodes = _nodes()

    def company_of(a: Column, card: Column) -> Column:
        marked = h.find(nodes, card, lambda x: F.coalesce(x["class"].rlike("(?i)company"), F.lit(False)))
        bold = h.find(nodes, card, lambda x: (x["tag"] == "b") & ~h.inside(x, a))
        return h.node_text(nodes, F.coalesce(marked, bold))

    structs = F.transform(
        _links(fv.BAYT_HREF),
        lambda a: F.struct(
            a["href"].alias("href"),
            h.node_text(nodes, a).alias("title"),
            company_of(a, _nearest(a, "li", "div", "article")).alias("company"),
        ),
    )
    rows = _link_rows(landing, "bayt", structs, cap)
    c = F.col
    return as_raw(
        rows, "bayt",
        external_id=c("url"),
        url=c("url"),
        title=c("title"),
        company=F.when((text_or_empty("company") != "") & (c("company") != c("title")), c("company")),
        description=c("title"),
        location=F.lit("Pakistan"),
        item_ord=item_ord(c("pos")),
    )


# ------------------------------------------------------------------ any page
def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, text) of every link of every page."""
    nodes = _nodes()
    links = F.transform(
        F.filter(nodes, lambda x: (x["tag"] == "a") & x["href"].isNotNull()),
        lambda a: F.struct(a["href"].alias("href"), h.node_text(nodes, a).alias("text")),
    )
    parsed = pages.select(key, h.html_nodes(html).alias("nodes"))
    return parsed.select(key, F.posexplode(links).alias("pos", "l")).select(key, "pos", "l.*")


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text): the readable text of every page, one line per text node."""
    return pages.select(key, h.html_to_text(html).alias("text"))
