"""Ranked search, profiles and matching."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.base import B0, B1, TITLES, check, jobs, table, with_jobs
from listwright import fixed_values as fv
from listwright.operators import match
from listwright.operators.search import search, search_batch
from listwright.session import spread

SEP = r"[\s_/-]+"


def _esc(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text).replace("'", "''")


# ------------------------------------------------------------------ search oracles
def _form(form: str) -> str:
    body = SEP.join(_esc(p) for p in form.split())
    before = B0 if form[0].isalnum() else ""
    after = r"(s|es|js|\p{Nd}+|\.js)?" + B1 if form[-1].isalnum() else ""
    return f"{before}{body}{after}"


def _term(forms: list[str]) -> str:
    return "(?i)(" + "|".join(_form(f) for f in forms) + ")"


def _adjacent(terms: list[list[str]]) -> str:
    words = ["(" + "|".join(_esc(f) for f in forms) + ")" for forms in terms]
    return "(?i)" + B0 + SEP.join(words) + B1


FIELDS = [("title", 10.0), ("tags_text", 5.0), ("company", 2.0), ("description", 1.0)]


def search_sql(terms: list[tuple[list[str], bool]], excluded: list[list[str]], source: str = "jobs") -> str:
    """Plain SQL for one query; terms are (spellings, required)."""
    n = len(terms)
    hit = lambda pattern, f: f"CASE WHEN regexp_matches(coalesce({f}, ''), '{pattern}') THEN 1 ELSE 0 END"
    cols = []
    for i, (forms, _) in enumerate(terms):
        cols += [f"{hit(_term(forms), f)} AS t{i}_{k}" for k, (f, _) in enumerate(FIELDS)]
    words = [forms for forms, _ in terms]
    if n > 1:
        cols += [f"{hit(_adjacent(words), f)} AS w_{k}" for k, (f, _) in enumerate(FIELDS)]
        for i in range(n - 1):
            cols += [f"{hit(_adjacent(words[i:i + 2]), f)} AS p{i}_{k}" for k, (f, _) in enumerate(FIELDS)]
    bad = " OR ".join(
        f"regexp_matches(coalesce({f}, ''), '{_term(forms)}')" for forms in excluded for f, _ in FIELDS
    ) or "false"
    weights = [w for _, w in FIELDS]
    sums = [" + ".join(f"t{i}_{k} * {w}" for k, w in enumerate(weights)) for i in range(n)]
    bests = ["greatest(" + ", ".join(f"t{i}_{k} * {w}" for k, w in enumerate(weights)) + ")" for i in range(n)]
    found = " + ".join(f"CASE WHEN b{i} > 0 THEN 1 ELSE 0 END" for i in range(n))
    required = " AND ".join(["true"] + [f"b{i} > 0" for i, (_, r) in enumerate(terms) if r])
    strong = " OR ".join(f"b{i} > 1" for i in range(n))
    idf = [f"greatest(0.5, 1 + 0.15 * (ln(1 + n / (1.0 + d{i})) - 1))" for i in range(n)]
    boost = lambda i: 2.0 if n > 1 and i == n - 1 else 1.0
    score = " + ".join(f"(b{i} + 0.1 * (s{i} - b{i})) * {boost(i)} * {idf[i]}" for i in range(n))
    if n > 1:
        per_field = " + ".join(
            f"CASE WHEN w_{k} = 1 THEN {1.2 * n * w} ELSE 0.5 * {w} * ("
            + " + ".join(f"p{i}_{k}" for i in range(n - 1)) + ") END"
            for k, w in enumerate(weights)
        )
        score += f" + CASE WHEN matched > 1 THEN {per_field} ELSE 0 END"
    counts = ", ".join(f"count(*) FILTER (b{i} > 0) OVER () AS d{i}" for i in range(n))
    floor = "WHERE relevance >= 0.25 * best" if n > 1 else ""
    return f"""SELECT id, round(relevance, 6) AS relevance FROM (SELECT *, max(relevance) OVER () AS best FROM (
      SELECT id, {score} AS relevance FROM (
        SELECT *, count(*) OVER () AS n, {counts} FROM (
          SELECT *, {found} AS matched FROM (
            SELECT *, {", ".join(f"{x} AS s{i}" for i, x in enumerate(sums))},
              {", ".join(f"{x} AS b{i}" for i, x in enumerate(bests))}
            FROM (SELECT id, {", ".join(cols)} FROM {source} WHERE NOT ({bad}))))
        WHERE {required} AND matched > 0 AND (matched = {n} OR {strong})))) {floor}"""


SEARCH_COLUMNS = ["id", "title", "tags", "company", "description"]


def _search(name: str, q: str, terms: list, excluded: list | None = None):
    @check(name, with_jobs(search_sql(terms, excluded or [])))
    def run(spark, d):
        found = search(jobs(spark, d).select(*SEARCH_COLUMNS), q)
        return found.select("id", F.round("relevance", 6).alias("relevance"))


_search("search_single_term", "security", [(["security", "cybersecurity", "infosec"], False)])
_search(
    "search_multi_term", "website security",
    [(["website", "web site", "web"], False), (["security", "cybersecurity", "infosec"], False)],
)
_search("search_phrase", '"full stack" mentor', [(["full stack"], True), (["mentor"], False)])
_search(
    "search_exclude", 'cloud auditor analyst -pipeline -"cloud cost"',
    [(["cloud"], False), (["auditor"], False), (["analyst"], False)], [["pipeline"], ["cloud cost"]],
)
_search(
    "search_aliases", "js k8s ml full-stack",
    [(["js", "javascript"], False), (["k8s", "kubernetes"], False), (["ml", "machine learning"], False),
     (["full-stack", "full stack"], False)],
)


@check(
    "search_exclusion_only",
    with_jobs(
        "SELECT id FROM jobs WHERE NOT (" + " OR ".join(
            f"regexp_matches(coalesce({f}, ''), '{_term(['cloud'])}')" for f, _ in FIELDS
        ) + ")"
    ),
)
def search_exclusion_only(spark, d):
    return search(jobs(spark, d).select(*SEARCH_COLUMNS), "-cloud").select("id")


def part_listings(spark, d):
    return spread(table(spark, d, "part"), "p_partkey").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.array("p_type").alias("tags"), F.col("p_brand").alias("company"),
        F.lit("").alias("description"),
    )


_PARTS = (
    "WITH parts AS (SELECT p_partkey AS id, p_name AS title, p_type AS tags_text, "
    "p_brand AS company, '' AS description FROM part) "
)


@check(
    "search_parts",
    _PARTS + search_sql([(["red"], False), (["economy"], False), (["widget"], False)], [["brand#1"]], "parts"),
)
def search_parts(spark, d):
    found = search(part_listings(spark, d), "red economy widget -brand#1")
    return found.select("id", F.round("relevance", 6).alias("relevance"))


# ------------------------------------------------------------------ batch search
def _spellings(word: str) -> list[str]:
    squashed = re.sub("[^a-z0-9]", "", word.lower())
    same = fv.ALIASES.get(word.lower(), []) + fv.ALIASES.get(squashed, [])
    return [word, *dict.fromkeys(f for f in same if f != word)]


def _title_query_sql(title: str) -> str:
    terms = [(_spellings(w), False) for w in title.split()]
    return f"SELECT '{title}' AS query_id, * FROM ({search_sql(terms, [])})"


@check("search_batch", with_jobs(" UNION ALL ".join(_title_query_sql(t) for t in TITLES)))
def search_batch_titles(spark, d):
    listings = jobs(spark, d).select(*SEARCH_COLUMNS)
    queries = listings.select(F.col("title").alias("query_id"), F.col("title").alias("q")).distinct()
    return search_batch(listings, queries).select("query_id", "id", F.round("relevance", 6).alias("relevance"))


_TEN = "cloud security auditor analyst web shop operator data pipeline lead"
_WITH_WEB = " OR ".join(f"regexp_matches(coalesce({f}, ''), '{_term(['web'])}')" for f, _ in FIELDS)


@check(
    "search_batch_exclusions",
    with_jobs(
        f"""SELECT 'ten' AS query_id, * FROM ({search_sql([(_spellings(w), False) for w in _TEN.split()], [["cloud cost"]])})
        UNION ALL SELECT 'only', id, CAST(NULL AS DOUBLE) FROM jobs WHERE NOT ({_WITH_WEB})
        UNION ALL SELECT 'nothing', id, CAST(NULL AS DOUBLE) FROM jobs"""
    ),
)
def search_batch_exclusions(spark, d):
    """Ten terms and an exclusion behind them, an exclusion alone, and an empty query."""
    queries = spark.createDataFrame(
        [("ten", f'{_TEN} -"cloud cost"'), ("only", "-web"), ("nothing", " ")], "query_id string, q string"
    )
    found = search_batch(jobs(spark, d).select(*SEARCH_COLUMNS), queries)
    return found.select("query_id", "id", F.round("relevance", 6).alias("relevance"))


# Part names are two plain words, so words can be compared instead of patterns.
@check(
    "search_batch_parts",
    """WITH queries AS (SELECT DISTINCT p_name AS q FROM part),
    terms AS (SELECT q, unnest(string_split(q, ' ')) AS word, generate_subscripts(string_split(q, ' '), 1) AS pos FROM queries),
    words AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word, 10.0 AS w FROM part
      UNION ALL SELECT p_partkey, lower(p_type), 5.0 FROM part),
    per_term AS (SELECT q, pos, id, max(w) AS b, sum(w) AS s FROM terms JOIN words USING (word) GROUP BY ALL),
    corpus AS (SELECT q, count(DISTINCT id) AS n FROM per_term GROUP BY q),
    freq AS (SELECT q, pos, count(*) AS df FROM per_term GROUP BY ALL),
    scored AS (SELECT q, id, sum((b + 0.1 * (s - b)) * CASE WHEN pos = 2 THEN 2.0 ELSE 1.0 END
          * greatest(0.5, 1 + 0.15 * (ln(1 + n / (1.0 + df)) - 1)))
        + CASE WHEN any_value(p_name) = q THEN 24.0 ELSE 0 END AS relevance
      FROM per_term JOIN corpus USING (q) JOIN freq USING (q, pos) JOIN part ON p_partkey = id GROUP BY q, id)
    SELECT q AS query_id, id, round(relevance, 6) AS relevance
    FROM (SELECT *, max(relevance) OVER (PARTITION BY q) AS best FROM scored) WHERE relevance >= 0.25 * best""",
)
def search_batch_parts(spark, d):
    listings = part_listings(spark, d)
    queries = listings.select(F.col("title").alias("query_id"), F.col("title").alias("q")).distinct()
    return search_batch(listings, queries).select("query_id", "id", F.round("relevance", 6).alias("relevance"))


# ------------------------------------------------------------------ profiles
def skill_sql(skill: str, text: str) -> str:
    before = B0 if skill[0].isalnum() else ""
    after = B1 if skill[-1].isalnum() else ""
    return f"(contains({text}, '{skill}') AND regexp_matches({text}, '{before}{_esc(skill)}{after}'))"


def skills_sql(skills: list[str], text: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {skill_sql(s, text)} THEN '{s}' END" for s in skills) + ")"


_EDGE = r"([^\pL\pN_]|$)"
_SENIORITY = f"""CASE
    WHEN regexp_matches(text, '(?i){B0}({fv.SENIORITY_LEAD}){_EDGE}') THEN 'lead'
    WHEN regexp_matches(text, '(?i){B0}(senior{_EDGE}|sr{_EDGE}|sr\\.[\\pL\\pN_])') THEN 'senior'
    WHEN regexp_matches(text, '(?i){B0}(junior{_EDGE}|jr{_EDGE}|jr\\.[\\pL\\pN_]|intern{_EDGE}|entry[- ]level{_EDGE}|graduate{_EDGE})') THEN 'junior'
    ELSE 'mid' END"""


def _resume_sql(text: str) -> str:
    return f"""SELECT id, {skills_sql(fv.SKILLS_VOCABULARY, 'lower(text)')} AS skills, {_SENIORITY} AS seniority,
      trim(regexp_replace(text, '\\s+', ' ', 'g')) AS summary FROM {text}"""


@check("vocab_profile", with_jobs(_resume_sql("(SELECT id, title || ' at ' || coalesce(company, '') || '. ' || tags_text || chr(10) || description AS text FROM jobs)")))
def vocab_profile(spark, d):
    text = F.concat(
        "title", F.lit(" at "), F.coalesce("company", F.lit("")), F.lit(". "),
        F.array_join("tags", " "), F.lit("\n"), "description",
    )
    profiles = match.profiles_from_texts(jobs(spark, d).select("id", text.alias("text")))
    return profiles.select("id", F.array_join("skills", ",").alias("skills"), "seniority", "summary")


@check("vocab_profile_documents", _resume_sql("(SELECT doc_id AS id, text FROM documents)"))
def vocab_profile_documents(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return match.profiles_from_texts(texts).select(
        "id", F.array_join("skills", ",").alias("skills"), "seniority", "summary"
    )


@check(
    "profile_text",
    with_jobs(
        """SELECT company, trim(concat_ws(chr(10), 'Works at ' || company, CASE WHEN titles <> '' THEN 'Roles: ' || titles END,
          CASE WHEN skills <> '' THEN 'Skills: ' || skills END)) AS profile
        FROM (SELECT company, string_agg(DISTINCT title, ', ' ORDER BY title) AS titles,
            coalesce(string_agg(DISTINCT CASE WHEN tags_csv = 'part_time' THEN 'part_time' END, ', '), '') AS skills
          FROM jobs WHERE company IS NOT NULL GROUP BY company)"""
    ),
)
def profile_text(spark, d):
    part_time = F.when(F.array_contains("tags", "part_time"), "part_time")
    profiles = jobs(spark, d).filter("company is not null").groupBy("company").agg(
        F.array_sort(F.collect_set("title")).alias("titles"), F.collect_set(part_time).alias("skills"),
        F.concat(F.lit("Works at "), F.first("company")).alias("summary"),
    )
    return profiles.select("company", match.profile_text().alias("profile"))


@check(
    "model_profile_fallback",
    with_jobs(
        f"""SELECT id, CASE WHEN id % 3 = 0 AND tags_csv <> '' THEN replace(tags_csv, ',', '|') ELSE {skills_sql(["python", "go", "api"], "lower(title || ' ' || tags_text)")} END AS skills,
          CASE WHEN id % 3 = 0 THEN 'model' ELSE 'heuristic' END AS seniority
        FROM jobs""".replace("concat_ws(','", "concat_ws('|'")
    ),
)
def model_profile_fallback(spark, d):
    rows = jobs(spark, d)
    text = F.concat("title", F.lit(" "), F.array_join("tags", " "))
    heuristic = match.profiles_from_texts(
        rows.select("id", text.alias("text")), ["python", "go", "api"]
    ).withColumn("seniority", F.lit("heuristic"))
    model = rows.filter(F.col("ai_reason").isNotNull()).select(
        "id", F.col("tags").alias("skills"), F.array("title").alias("titles"),
        F.lit("model").alias("seniority"), F.lit("").alias("summary"),
    )
    return match.prefer_model(model, heuristic, "id").select(
        "id", F.array_join("skills", "|").alias("skills"), "seniority"
    )


# ------------------------------------------------------------------ matching
SKILLS = ["Python", "laravel", "c++", "api", " machine learning ", "python", "kubernetes", "web"]
_CLEAN = ["python", "laravel", "c++", "api", "machine learning", "kubernetes", "web"]
_LOW = "lower(title || chr(10) || description || chr(10) || tags_text)"
_COUNT = " + ".join(f"CASE WHEN {skill_sql(s, _LOW)} THEN 1 ELSE 0 END" for s in _CLEAN)


@check(
    "resume_match_rank",
    with_jobs(
        f"""SELECT id, hits, CAST(hit_count AS INTEGER) AS hit_count, n FROM (
          SELECT *, row_number() OVER (ORDER BY hit_count DESC, coalesce(ai_score, -1) DESC,
            coalesce(posted_at, fetched_at) DESC, fetched_at DESC, id) AS n
          FROM (SELECT *, {skills_sql(_CLEAN, _LOW)} AS hits, {_COUNT} AS hit_count FROM jobs WHERE status <> 'ignored')
          WHERE hit_count > 0) WHERE n <= 50"""
    ),
)
def resume_match_rank(spark, d):
    from pyspark.sql import Window

    from listwright.plans.feed import take_page

    found = match.match_profile(jobs(spark, d), SKILLS)
    order = match.match_order()
    top = take_page(found, order, 1, size=50)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long")).select(
        "id", F.array_join("hits", ",").alias("hits"), "hit_count", "n"
    )


@check(
    "resume_match_all",
    with_jobs(
        f"""SELECT id, {skills_sql(_CLEAN, _LOW)} AS hits, CAST({_COUNT} AS INTEGER) AS hit_count
        FROM jobs WHERE status <> 'ignored' AND ({_COUNT}) > 0"""
    ),
)
def resume_match_all(spark, d):
    return match.match_profile(jobs(spark, d), SKILLS).select(
        "id", F.array_join("hits", ",").alias("hits"), "hit_count"
    )


@check(
    "resume_match_batch",
    with_jobs(
        f"""SELECT profile_id, id, string_agg(skill, ',' ORDER BY pos) AS hits, CAST(count(*) AS INTEGER) AS hit_count
        FROM (SELECT title AS profile_id, unnest(found) AS skill, generate_subscripts(found, 1) AS pos
          FROM (SELECT title, string_split({skills_sql(fv.SKILLS_VOCABULARY, "lower(title || ' ' || tags)")}, ',') AS found
            FROM (SELECT title, string_agg(DISTINCT tags_text, ' ') AS tags FROM jobs GROUP BY title))) s
        JOIN (SELECT id, unnest(string_split({skills_sql(fv.SKILLS_VOCABULARY, _LOW)}, ',')) AS skill
          FROM jobs WHERE status <> 'ignored') j USING (skill)
        WHERE skill <> '' GROUP BY ALL"""
    ),
)
def resume_match_batch(spark, d):
    rows = jobs(spark, d)
    # One profile per distinct title, its text being the title and all tags listed under it.
    texts = rows.groupBy("title").agg(
        F.concat(F.first("title"), F.lit(" "),
                 F.array_join(F.collect_set(F.array_join("tags", " ")), " ")).alias("text")
    ).withColumnRenamed("title", "profile_id")
    profiles = match.profiles_from_texts(texts)
    return match.match_profiles(rows, profiles).select(
        "profile_id", "id", F.array_join("hits", ",").alias("hits"), "hit_count"
    )
