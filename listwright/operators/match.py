"""Skills in texts, profiles from texts, and profiles against listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions.scalars import seniority
from listwright.functions.text import END, START, bind, escape, opening, squeeze, strip, text_or_empty
from listwright.operators.predicates import effective_time, status_filter
from listwright.operators.dedupe import top_per_key
from listwright.operators.postings import FREE, find_forms, find_marks, postings
from listwright.operators.probes import lookup_words, words_of
from listwright.session import keep_computed, written


def skill_pattern(skill: str) -> str:
    """The skill as a whole word; an edge next to punctuation is left open (C++11)."""
    before = START if skill[:1].isalnum() else ""
    after = END if skill[-1:].isalnum() else ""
    return before + escape(skill) + after


def clean_skills(skills: list[str]) -> list[str]:
    return list(dict.fromkeys(s.strip().lower() for s in skills if s and s.strip()))


def skills_found(text: Column, skills: list[str]) -> Column:
    """Which of the skills occur in the lower-cased text, in the order of the list."""
    word = {skill: lookup_words(skill)[0] for skill in skills}
    table = F.array(
        *[
            F.struct(
                F.lit(skill).alias("skill"), F.lit(word[skill]).alias("word"),
                F.lit(skill_pattern(skill)).alias("pattern"),
            )
            for skill in skills
        ]
    )
    wanted = F.array(*map(F.lit, sorted(set(word.values())))).cast("array<string>")

    # The text is cut into words once; only skills whose first word is there run a pattern.
    def among(words: Column) -> Column:
        return F.filter(
            table,
            lambda s: F.array_contains(words, s["word"])
            & F.contains(text, s["skill"]) & F.rlike(text, s["pattern"]),
        )

    hits = bind(F.array_intersect(words_of(text), wanted), among)
    return F.transform(hits, lambda s: s["skill"])


def match_text() -> Column:
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return F.lower(
        F.concat(text_or_empty("title"), F.lit("\n"), text_or_empty("description"), F.lit("\n"), tags)
    )


# ------------------------------------------------------------------ profiles
def profiles_from_texts(
    texts: DataFrame, vocabulary: list[str] | None = None, summary_chars: int | None = None
) -> DataFrame:
    """(…, text) -> (…, skills, titles, seniority, summary), one row per text.

    The summary is the text on one line, or its first ``summary_chars`` characters.
    """
    vocabulary = clean_skills(fv.SKILLS_VOCABULARY if vocabulary is None else vocabulary)
    keep = [c for c in texts.columns if c != "text"]
    rows = texts.withColumn("_low", F.lower(text_or_empty("text")))
    text = text_or_empty("text")
    summary = squeeze(text) if summary_chars is None else opening(text, summary_chars)
    return rows.select(
        *keep,
        skills_found(F.col("_low"), vocabulary).alias("skills"),
        F.array().cast("array<string>").alias("titles"),
        seniority(text_or_empty("text")).alias("seniority"),
        summary.alias("summary"),
    )


def prefer_model(model: DataFrame, heuristic: DataFrame, key: str) -> DataFrame:
    """Profiles from a model where there are any; its empty skill lists are filled in."""
    m, h = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"h.{c}"))
    has_model = m("seniority").isNotNull()
    filled = F.coalesce(F.when(F.size(m("skills")) > 0, m("skills")), h("skills"))
    pick = lambda c: F.when(has_model, m(c)).otherwise(h(c)).alias(c)
    return heuristic.alias("h").join(model.alias("m"), key, "left").select(
        key, filled.alias("skills"), pick("titles"), pick("seniority"), pick("summary")
    )


def profile_text() -> Column:
    """Summary, roles and skills of a profile row as the text scorers get."""
    roles, skills = (F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
                     for c in ("titles", "skills"))
    return strip(
        F.concat_ws(
            "\n",
            F.nullif(F.col("summary"), F.lit("")),
            F.when(roles != "", F.concat(F.lit("Roles: "), roles)),
            F.when(skills != "", F.concat(F.lit("Skills: "), skills)),
        )
    )


def read_profile_files(
    spark, path: str, max_bytes: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """(path, text, error) of text files; bytes that are not UTF-8 are left out.

    With limits, larger files are refused and longer texts cut.
    """
    name = F.lower("path")
    raw = F.col("content").cast("string")
    decoded = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    )
    text = strip(decoded)
    unsupported = name.rlike(r"\.(?:pdf|docx|doc)$")
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    error = (
        F.when(unsupported, "unsupported file type")
        .when(too_large, "file too large")
        .when(text == "", "no text")
    )
    return spark.read.format("binaryFile").load(path).select(
        "path",
        F.when(error.isNull(), text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"),
        error.alias("error"),
    )


# ------------------------------------------------------------------ matching
def match_profile(listings: DataFrame, skills: list[str]) -> DataFrame:
    """Active listings with at least one of the skills: adds ``hits`` and ``hit_count``."""
    wanted = clean_skills(skills)
    rows = listings.filter(status_filter(None)).withColumn("_low", match_text())
    hits = bind(skills_found(F.col("_low"), wanted), lambda h: F.when(F.size(h) > 0, h))
    return (
        keep_computed(rows, "hits", hits).withColumn("hit_count", F.size("hits")).drop("_low")
    )


def match_order() -> list[Column]:
    return [
        F.desc("hit_count"), F.desc(F.coalesce("ai_score", F.lit(-1))),
        F.desc(effective_time()), F.desc("fetched_at"), F.asc("id"),
    ]


# Listings with one skill that meet the profiles with it in one task; a skill of more listings is split.
SPLIT_ROWS = 100_000


def match_profiles(listings: DataFrame, profiles: DataFrame, min_hits: int = 1, top: int | None = None) -> DataFrame:
    """(profile_id, id, hits, hit_count) for every profile and active listing that share ``min_hits`` skills or more.

    ``profiles`` has (profile_id, skills), a row per profile. With ``top``, only each profile's first listings in the order
    of ``match_order`` stay.

    A set join by the rarest skill: each skill is searched once, skills are ordered by the number of listings that have
    them, and a pair comes up only at the rarest skill it shares, with all that it shares at hand. So pairs are neither
    repeated nor brought together afterwards. Profiles with the same skills are one class until the end. Of a class, only
    as many rare skills are joined as a pair cannot do without. Skills of many listings are counted and split.
    """
    cleaned = F.array_distinct(F.filter(F.transform("skills", lambda s: F.lower(strip(s))), lambda s: s.isNotNull() & (s != "")))
    classed = profiles.select("profile_id", cleaned.alias("wanted")).filter(F.size("wanted") >= max(1, min_hits))
    classed = written(classed.withColumn("class", F.sha2(F.to_json("wanted"), 256)), "match-profiles")
    classes = classed.select("class", "wanted").distinct()
    forms = classes.select(F.explode("wanted").alias("form")).distinct()
    active = listings.filter(status_filter(None))
    forms = forms.select(F.col("form").alias("unit"), "form", F.lit(FREE).alias("mode"))
    texts = active.select("id", match_text().alias("text"))
    found = find_forms(postings(texts, {1: "text"}), forms)
    if not forms.filter(~F.rlike("form", F.lit(r"[\p{L}\p{N}]"))).isEmpty():
        found = found.unionByName(find_marks(texts, "text", forms))
    found = written(found.withColumnRenamed("unit", "skill"), "match-skills")
    counts = found.groupBy("skill").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / SPLIT_ROWS)
    # What a listing has, rarest first.
    have = (
        found.join(counts, "skill").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "skill"))).alias("have")).filter(F.size("have") >= min_hits)
    )
    here = have.select("id", F.transform("have", lambda h: h["skill"]).alias("has"), F.explode("have").alias("h")).select(
        "id", "has", "h.skill", F.pmod(F.xxhash64("id"), F.ceil(F.col("h.n") / SPLIT_ROWS)).alias("part")
    )
    asked = (
        classes.select("class", "wanted", F.explode("wanted").alias("skill")).join(counts, "skill")
        .groupBy("class", "wanted").agg(F.sort_array(F.collect_list(F.struct("n", "skill"))).alias("asked"))
        .select("class", "wanted", F.explode(F.slice("asked", F.lit(1), F.greatest(F.size("asked") - min_hits + 1, F.lit(0)))).alias("a"))
        .select("class", "wanted", "a.skill", F.col("a.n").alias("n"))
    )
    asked = asked.select("class", "wanted", "skill", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    rarest = F.get(F.array_intersect("has", "wanted"), F.lit(0))
    pairs = (
        here.join(asked, ["skill", "part"]).filter(rarest == F.col("skill"))
        .select("class", "id", F.array_intersect("wanted", "has").alias("hits"))
        .withColumn("hit_count", F.size("hits")).filter(F.col("hit_count") >= min_hits)
    )
    if top is not None:
        order = active.select("id", "ai_score", "posted_at", "fetched_at")
        # Limited in front of the shuffle as well.
        pairs = top_per_key(pairs.join(order, "id"), ["class"], match_order(), top).select("class", "id", "hits", "hit_count")
    return classed.select("profile_id", "class").join(pairs, "class").select("profile_id", "id", "hits", "hit_count")
