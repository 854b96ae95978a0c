"""Search behaviour on small invented listings, and both forms against brute force."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.operators.search import listing_index, read_query, search, search_batch

SCHEMA = "id long, title string, company string, tags array<string>, description string"


def listings(spark, *rows):
    """Rows are titles or (title, description[, tags[, company]])."""
    full = []
    for i, row in enumerate(rows):
        title, desc, tags, company = (*((row,) if isinstance(row, str) else row), None, None, None)[:4]
        full.append((i, title, company, tags, desc))
    return spark.createDataFrame(full, SCHEMA)


def ranked(df, q):
    return [r.title for r in search(df, q).orderBy(F.desc("relevance"), "id").collect()]


CASES = [
    # (listings, query, titles in order)
    ([("Painter", "uses python"), "Python Painter"], "python", ["Python Painter", "Painter"]),
    ([("Rust Sculptor", "developer wanted"), ("Rust Developer", "x")], "rust developer", ["Rust Developer"]),
    ([("Analyst", "kubernetes once"), ("Engineer", "", ["Kubernetes", "Go"])], "kubernetes", ["Engineer", "Analyst"]),
    (["Deep Learning Lead", ("Learning Guide", "deep sea")], '"deep learning"', ["Deep Learning Lead"]),
    (["Full-Stack Dev", "Full Moon Dev"], '"full stack"', ["Full-Stack Dev"]),
    (["Drupal Developer", "Backend Developer"], "developer -drupal", ["Backend Developer"]),
    (["Drupal Developer", "Backend Developer"], '-"drupal developer"', ["Backend Developer"]),
    (["Java Developer", "JavaScript Developer"], "java", ["Java Developer"]),
    (["Web Developer", "Website Developer"], "web", ["Web Developer", "Website Developer"]),
    (["APIs Person"], "api", ["APIs Person"]),
    (["Python3 Person"], "python", ["Python3 Person"]),
    (["C++ Person", "C Person"], "c++", ["C++ Person"]),
    ([".NET Person", "Internet Person"], ".net", [".NET Person"]),
    (["JavaScript Person"], "js", ["JavaScript Person"]),
    (["Kubernetes Person"], "k8s", ["Kubernetes Person"]),
    (["Cybersecurity Person"], "security", ["Cybersecurity Person"]),
    (["Éai Person"], "ai", []),
    (["Chef"], "python", []),
]


@pytest.mark.parametrize("rows,q,want", CASES, ids=[c[1] for c in CASES])
def test_ranking(spark, rows, q, want):
    assert ranked(listings(spark, *rows), q) == want


def test_head_word_decides(spark):
    df = listings(
        spark, ("Senior Web Developer", "Our website. Security matters."), ("Website Painter", "Security training."),
        ("Security Lead", "Threats."), ("Application Security Person", "Reviews."),
        ("Web Security Person", "Pen tests."), ("Bookkeeper", "Payroll."),
    )
    order = ranked(df, "website security")
    assert order[0] == "Web Security Person"
    assert {"Security Lead", "Application Security Person"} <= set(order)
    assert "Bookkeeper" not in order
    noise = [order.index(t) for t in ("Senior Web Developer", "Website Painter") if t in order]
    assert all(n > order.index("Security Lead") for n in noise)


@pytest.mark.parametrize("q", ["", "   ", None, '""', "-", "!!!", '  "" - '])
def test_queries_that_say_nothing(spark, q):
    got = search(listings(spark, "A", "B"), q).collect()
    assert len(got) == 2 and all(r.relevance is None for r in got)


def test_exclusions_have_no_scores(spark):
    got = search(listings(spark, "Drupal", "Other"), "-drupal").collect()
    assert [(r.title, r.relevance) for r in got] == [("Other", None)]


def test_term_limit():
    assert len(read_query("a b c d e f g h i j k").terms) == 11
    assert [t.text for t in read_query("a b c d e f g h i j -z").excluded] == ["z"]
    limit = fv.MAX_TERMS
    assert len(read_query("a b c d e f g h i j k", limit).terms) == limit
    # The limit is only looked at after a bare word; what follows it is not read.
    assert len(read_query('a b c d e f g "h h" "i i" j k -z', limit).terms) == 10
    assert read_query("a b c d e f g h -z", limit).excluded == []
    assert read_query('x -y -"z z"').terms[-1].text == "x" and len(read_query('x -y -"z z"').excluded) == 2


def test_weak_tail_is_cut(spark):
    noise = [(f"Nurse {i}", "Care.", ["Full-time"]) for i in range(20)]
    got = ranked(listings(spark, ("Full Stack Person", "React."), *noise), "full stack")
    assert got[0] == "Full Stack Person" and len(got) < 21
    both = ranked(listings(spark, "Security Person", ("Developer", "We like security.")), "security")
    assert len(both) == 2


# ------------------------------------------------------------------ brute force
def brute_force(rows, q):
    """The ranking rules written down once more, row by row."""
    query = read_query(q)
    to_python = lambda p: re.compile(
        p.replace("(?iu)", "").replace(r"[\p{L}\p{N}_]", r"\w").replace(r"\p{Nd}", r"\d")
        .replace(r"[\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}_\-/]", r"[\s_\-/]"), re.I
    )
    weights = [10.0, 5.0, 2.0, 1.0]
    survivors = []
    for i, title, company, tags, desc in rows:
        texts = [title or "", " ".join(tags or []), company or "", desc or ""]
        hit = lambda p: [w for t, w in zip(texts, weights) if to_python(p).search(t)]  # noqa: E731,B023
        if any(hit(t.pattern) for t in query.excluded):
            continue
        hits = [hit(t.pattern) for t in query.terms]
        found = sum(map(bool, hits))
        if not found or any(t.required and not h for t, h in zip(query.terms, hits)):
            continue
        if found < len(hits) and not any(max(h, default=0) > 1 for h in hits):
            continue
        bonus = 0.0
        if found > 1:
            for t, w in zip(texts, weights):
                if to_python(query.whole_pattern).search(t):
                    bonus += 1.2 * len(hits) * w
                else:
                    bonus += 0.5 * w * sum(bool(to_python(p).search(t)) for p in query.pair_patterns)
        survivors.append((i, hits, bonus))
    n = len(survivors)
    scores = {}
    for i, hits, bonus in survivors:
        total = bonus
        for k, h in enumerate(hits):
            df = sum(bool(s[1][k]) for s in survivors)
            idf = max(0.5, 1 + 0.15 * (math.log(1 + n / (1 + df)) - 1))
            head = 2.0 if len(hits) > 1 and k == len(hits) - 1 else 1.0
            total += (max(h) + 0.1 * (sum(h) - max(h))) * head * idf if h else 0.0
        scores[i] = total
    if len(query.terms) > 1 and scores:
        floor = 0.25 * max(scores.values())
        scores = {i: s for i, s in scores.items() if s >= floor}
    return {i: round(s, 6) for i, s in scores.items()}


WORDS = ["web", "website", "Web Site", "security", "infosec", "C++", "c", "node.js", "Node", "k8s", "k812", "365",
         "3d", "full-stack", "full", "stack", "apis", "API", "python3", "éai", "ai", "x_y", "developer"]
QUERIES = ["web security", '"full stack" developer', "k8s -c++", "node.js api", "python ai", "365 3d", "fullstack",
           "k8 website", '"web site" -ai', "c++ developer", "x developer api ai"]
text = st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join)
row = st.tuples(text, st.none() | text, st.none() | st.lists(st.sampled_from(WORDS), max_size=2), text)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=8, max_size=25))
def test_against_brute_force(spark, rows):
    data = [(i, t, c, g, d) for i, (t, c, g, d) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, q string").coalesce(1)
    got = {i: {} for i in range(len(QUERIES))}
    for r in search_batch(df, queries).collect():
        got[r.query_id][r.id] = round(r.relevance, 6)
    for i, q in enumerate(QUERIES):
        assert got[i] == pytest.approx(brute_force(data, q)), q
    q = QUERIES[0]
    one = {r.id: round(r.relevance, 6) for r in search(df, q).collect()}
    assert one == pytest.approx(brute_force(data, q))


def test_words_are_joined_by_shuffle_too(spark):
    """The same answer where nothing is small enough to be broadcast."""
    data = [(i, t, None, None, None) for i, t in enumerate(["web security", "C++ developer", "365 days", "k812 api"])]
    df = spark.createDataFrame(data, SCHEMA)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, q string")
    want = sorted(map(tuple, search_batch(df, queries).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, search_batch(df, queries).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ------------------------------------------------------------------ forms by positions
ODD_TEXTS = [
    "web security", "_web security", "web_security_", "web  --/ security web", "C++11 c++", ".NET ASP.NET x.net", "node.js Node.JS_",
    "nodeXjs", "front-end frontend front  end", "365 3651 36 365s 365js", "k8 k812 k81x", "apis apies apijs api.js api2 api_2",
    "é éai ai", "c ++ d", "a.b.c a.b c", "x", "", None, "___", "- -", "web site security", "web web site security x",
    "½ 5½ ²", "full stack full stack developer", "security.web", "c++ developer", "c++ .net", "a c++-.net b", "٣٤ api٣",
]
ODD_QUERIES = [
    "web security", "c++", ".net", "node.js", '"front end"', "365", "36 5", "k8", "api", "ai", '"c ++"', "a.b", "full stack developer",
    "web site security", "c++ .net", "x_y", "website security x", "3", '"full stack" full', "c++ developer", '"- x"', "web -365", "5",
]


def test_positions_say_what_patterns_say(spark):
    """Forms, pairs and phrases by positions against the patterns of the single search, in every field."""
    data = [(i, t, None, None, t) for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    queries = spark.createDataFrame(list(enumerate(ODD_QUERIES)), "query_id int, q string").coalesce(1)
    got = {i: {} for i in range(len(ODD_QUERIES))}
    for r in search_batch(df, queries).collect():
        got[r.query_id][r.id] = round(r.relevance, 6)
    for i, q in enumerate(ODD_QUERIES):
        assert got[i] == pytest.approx(brute_force(data, q)), q


def test_a_stored_index_is_searched(spark, tmp_path):
    data = [(i, t, None, None, t) for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, q string").coalesce(1)
    listing_index(df).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(map(tuple, search_batch(df, queries, stored).collect())) == sorted(map(tuple, search_batch(df, queries).collect()))
