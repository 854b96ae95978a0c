"""Sources that answer with JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions import scalars as s
from listwright.functions.html import html_to_text, resolve_entities
from listwright.functions.text import (
    blank_to_null, clean_tags, empty_to_null, joined, squeeze, strip, text_or_empty,
)
from listwright.operators.dedupe import first_per_key, top_per_key
from listwright.sources.landing import (
    as_raw, field, field_list, field_names, first_text, item_ord, json_items, truthy,
)


def _complete(df: DataFrame) -> DataFrame:
    """Rows with an address and a title that says something."""
    return df.filter((text_or_empty("url") != "") & (text_or_empty("title") != ""))


def _plain(c: Column) -> Column:
    return squeeze(resolve_entities(c))


def _when(value: Column) -> Column:
    return s.parse_iso_or_epoch(value)


def _variant(path: str) -> Column:
    return F.try_variant_get("item", f"$.{path}", "variant")


def _capped(df: DataFrame, cap: int | None = None) -> DataFrame:
    """With a cap, only the first rows of each cycle, in the source's own order."""
    return df if cap is None else top_per_key(df, ["cycle_id"], ["item_ord"], cap)


def remoteok(landing: DataFrame) -> DataFrame:
    # The first element is a legal notice.
    items = json_items(landing, "remoteok", "$").filter("pos > 0")
    date = F.coalesce(
        _when(_variant("date")), F.when(empty_to_null(field("date")).isNull(), _when(_variant("epoch")))
    )
    return _complete(
        as_raw(
            items, "remoteok",
            external_id=text_or_empty(first_text("id", "slug")),
            url=first_text("url", "apply_url"),
            title=strip(first_text("position", "title")),
            company=blank_to_null(field("company")),
            description=html_to_text(field("description")),
            tags=clean_tags(field_list("tags")),
            budget=s.dollar_range(
                field("salary_min").try_cast("double"), field("salary_max").try_cast("double")
            ),
            location=blank_to_null(field("location")),
            posted_at=date,
            item_ord=item_ord(F.col("pos")),
        )
    )


def remotive(landing: DataFrame) -> DataFrame:
    return _complete(
        as_raw(
            json_items(landing, "remotive", "$.jobs"), "remotive",
            external_id=text_or_empty(field("id")),
            url=field("url"),
            title=strip(field("title")),
            company=blank_to_null(field("company_name")),
            description=html_to_text(field("description")),
            tags=clean_tags(field_list("tags")),
            budget=blank_to_null(field("salary")),
            location=blank_to_null(field("candidate_required_location")),
            posted_at=_when(_variant("publication_date")),
            item_ord=item_ord(F.col("pos")),
        )
    )


def jobicy(landing: DataFrame) -> DataFrame:
    return _complete(
        as_raw(
            json_items(landing, "jobicy", "$.jobs"), "jobicy",
            external_id=text_or_empty(field("id")),
            url=field("url"),
            title=strip(field("jobTitle")),
            company=blank_to_null(field("companyName")),
            description=html_to_text(first_text("jobDescription", "jobExcerpt")),
            tags=clean_tags(F.concat(field_list("jobIndustry"), field_list("jobType"))),
            budget=s.currency_range(
                field("salaryCurrency"), field("annualSalaryMin"), field("annualSalaryMax")
            ),
            location=blank_to_null(field("jobGeo")),
            posted_at=_when(_variant("pubDate")),
            item_ord=item_ord(F.col("pos")),
        )
    )


def arbeitnow(landing: DataFrame) -> DataFrame:
    remote = json_items(landing, "arbeitnow", "$.data").filter(truthy("remote"))
    tags = F.concat(field_list("tags"), field_list("job_types"), F.array(F.lit("remote")))
    return _complete(
        as_raw(
            remote, "arbeitnow",
            external_id=first_text("slug", "url"),
            url=field("url"),
            title=strip(field("title")),
            company=blank_to_null(field("company_name")),
            description=html_to_text(field("description")),
            tags=clean_tags(tags),
            location=blank_to_null(field("location")),
            posted_at=_when(_variant("created_at")),
            item_ord=item_ord(F.col("pos")),
        )
    )


def themuse(landing: DataFrame) -> DataFrame:
    items = json_items(landing, "themuse", "$.results").withColumn("names", field_names("locations"))
    places = F.lower(F.array_join("names", " "))
    remote = (F.size("names") == 0) | F.contains(places, F.lit("remote")) | F.contains(
        places, F.lit("flexible")
    )
    return _complete(
        as_raw(
            items.filter(remote), "themuse",
            external_id=text_or_empty(field("id")),
            url=field("refs.landing_page"),
            title=strip(field("name")),
            company=blank_to_null(field("company.name")),
            description=html_to_text(field("contents")),
            tags=clean_tags(F.concat(field_names("levels"), field_names("categories"))),
            location=empty_to_null(F.array_join("names", ", ")),
            posted_at=_when(_variant("publication_date")),
            item_ord=item_ord(F.col("pos")),
        )
    )


def _rendered(path: str) -> Column:
    """Text that may be wrapped as {"rendered": "…"}."""
    return F.coalesce(
        field(f"{path}.rendered"),
        F.when(F.schema_of_variant(_variant(path)) == "STRING", field(path)),
    )


def skipthedrive(landing: DataFrame) -> DataFrame:
    items = json_items(landing, "skipthedrive", "$").select(
        "*",
        _plain(_rendered("title")).alias("title"),
        html_to_text(_rendered("content")).alias("description"),
        resolve_entities(field("slug")).alias("slug"),
        resolve_entities(_rendered("title")).alias("slug_title"),
    )
    rows = _complete(
        as_raw(
            items, "skipthedrive",
            external_id=first_text("id", "link"),
            url=strip(field("link")),
            title=F.col("title"),
            company=s.company_from_slug(F.col("slug"), F.col("slug_title")),
            description=F.col("description"),
            budget=s.salary_in_text(F.col("description")),
            location=F.coalesce(s.location_in_text(F.col("description")), F.lit("Remote")),
            posted_at=_when(_variant("date_gmt")),
            item_ord=item_ord(F.col("pos")),
        )
    )
    return rows


def underdog(landing: DataFrame) -> DataFrame:
    answered = text_or_empty(field("error", "doc")).isin("", "false", "0")
    items = (
        json_items(landing, "underdog", "$.objJobs").filter(answered).filter(~truthy("is_expired"))
        .withColumn("slug", strip(first_text("webflow_slug", "slug")))
        .withColumn("title", _plain(field("title")))
        .filter("slug <> ''")
    )
    cities = F.filter(
        F.transform(
            F.coalesce(
                F.try_variant_get("item", "$.objCities", "array<variant>"),
                F.array().cast("array<variant>"),
            ),
            lambda c: s.city_label(
                F.try_variant_get(c, "$.name", "string"),
                F.try_variant_get(c, "$.state_abbreviation", "string"),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    amount = lambda p: field(p).try_cast("double").try_cast("long")
    rows = _complete(
        as_raw(
            items, "underdog",
            external_id=F.coalesce(first_text("id"), F.col("slug")),
            url=F.concat(F.lit(fv.BASE_URLS["underdog"]), F.col("slug")),
            title=F.col("title"),
            description=html_to_text(field("description")),
            tags=clean_tags(field_names("objCategories")),
            budget=s.compact_range(amount("min_salary"), amount("max_salary")),
            location=empty_to_null(F.array_join(cities, ", ")),
            posted_at=_when(_variant("created_at")),
            item_ord=item_ord(F.col("pos")),
        )
    )
    return first_per_key(rows, ["cycle_id", "url"], ["item_ord"])


def builtin(landing: DataFrame, cap: int | None = None) -> DataFrame:
    items = json_items(landing, "builtin", "$.data.customFilteredJobs.customFilteredJobs").filter(
        F.coalesce(F.try_variant_get("doc", "$.errors[0]", "variant").isNull(), F.lit(True))
    )
    path = strip(field("url"))
    absolute = F.when(path.startswith("http"), path).otherwise(
        F.concat(F.lit(fv.BASE_URLS["builtin"]), path)
    )
    items = items.filter(text_or_empty(path) != "").select(
        "*",
        _plain(field("title")).alias("title"),
        absolute.alias("url"),
        s.remote_label(_plain(field("remoteStatus")), truthy("isHybrid")).alias("remote"),
        empty_to_null(_plain(field("experienceLevel"))).alias("experience"),
        html_to_text(field("bodySummary")).alias("summary"),
        empty_to_null(_plain(field("location"))).alias("loc"),
        empty_to_null(_plain(field("originalLocation"))).alias("original"),
        empty_to_null(_plain(field("company.name"))).alias("company"),
    )
    facts = joined(" · ", F.col("remote"), F.col("experience"))
    rows = _complete(
        as_raw(
            items, "builtin",
            external_id=F.coalesce(first_text("id"), F.col("url")),
            url=F.col("url"),
            title=F.col("title"),
            company=F.col("company"),
            description=F.coalesce(
                empty_to_null(joined("\n", F.col("summary"), facts)), F.col("title")
            ),
            tags=clean_tags(F.array("remote", "experience")),
            location=F.coalesce("loc", "original"),
            item_ord=item_ord(F.col("pos")),
        )
    )
    return _capped(first_per_key(rows, ["cycle_id", "url"], ["item_ord"]), cap)


def hn_thread(landing: DataFrame) -> DataFrame:
    """(story_id): the newest 'who is hiring' thread, the official author preferred.

    Thread searches are landed with feed_key 'search', comments with the story id.
    """
    hits = json_items(landing.filter("feed_key = 'search'"), "hn", "$.hits")
    title = F.lower(text_or_empty(field("title")))
    hiring, asked = (F.contains(title, F.lit(p)) for p in fv.HN_THREAD_PHRASES)
    official = text_or_empty(field("author")) == fv.HN_THREAD_AUTHOR
    priority = F.when(hiring & official, 0).when(hiring & asked, 1)
    return (
        hits.select(
            "cycle_id", priority.alias("priority"), "pos",
            first_text("objectID", "story_id").alias("story_id"),
        )
        .filter("priority is not null")
        .groupBy("cycle_id").agg(
            F.min_by("story_id", F.struct("priority", "pos")).alias("story_id")
        )
    )


def hn(landing: DataFrame) -> DataFrame:
    threads = hn_thread(landing)
    comments = json_items(landing.filter("feed_key <> 'search'"), "hn", "$.children")
    rows = (
        # One row per cycle, and all comments of a cycle share the key: broadcast.
        comments.join(
            F.broadcast(threads.withColumnRenamed("story_id", "feed_key")),
            ["cycle_id", "feed_key"], "left_semi",
        )
        .filter(text_or_empty(field("text")) != "")
        .withColumn("plain", html_to_text(field("text")))
        .filter(F.contains(F.lower("plain"), F.lit("remote")) & truthy("id"))
        .withColumn("line", F.coalesce(F.try_element_at(F.split("plain", "\n"), F.lit(1)), F.lit("")))
    )
    return as_raw(
        rows, "hn",
        external_id=field("id"),
        url=F.concat(F.lit(fv.BASE_URLS["hn"]), field("id")),
        title=F.coalesce(empty_to_null("line"), F.lit("Who is hiring")),
        company=empty_to_null("line"),
        description=F.col("plain"),
        posted_at=_when(_variant("created_at")),
        item_ord=item_ord(F.col("pos")),
    )


def reddit(landing: DataFrame) -> DataFrame:
    """Posts marked [Hiring]; ``feed_key`` is the name of the subreddit."""
    rows = json_items(landing, "reddit", "$.data.children").select(
        "*", F.try_variant_get("item", "$.data", "variant").alias("post")
    )
    get = lambda p: field(p, "post")
    link = F.when(
        text_or_empty(get("permalink")) != "",
        F.concat(F.lit(fv.BASE_URLS["reddit"]), get("permalink")),
    ).otherwise(get("url"))
    rows = rows.select("*", strip(get("title")).alias("title"), link.alias("link")).filter(
        F.contains(F.lower("title"), F.lit("[hiring]"))
    )
    return _complete(
        as_raw(
            rows, "reddit",
            external_id=F.coalesce(empty_to_null(get("id")), F.col("link")),
            url=F.col("link"),
            title=F.col("title"),
            company=F.when(text_or_empty(get("author")) != "", F.concat(F.lit("u/"), get("author"))),
            description=F.coalesce(
                empty_to_null(html_to_text(get("selftext_html"))),
                blank_to_null(get("selftext")), F.col("title"),
            ),
            tags=clean_tags(F.array(F.col("feed_key"), get("link_flair_text"))),
            posted_at=s.parse_iso_or_epoch(F.try_variant_get("post", "$.created_utc", "variant")),
            item_ord=item_ord(F.col("pos")),
        )
    )
