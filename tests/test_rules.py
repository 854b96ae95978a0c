"""Scalar rules, ingest rules, lifecycle, feed pages and JSON sources on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from listwright.functions import scalars as s
from listwright.functions.text import clean_tags, strip
from listwright.operators import match
from listwright.operators import predicates as p
from listwright.operators.dedupe import number_rows
from listwright.plans import alerts, export, feed, ingest, lifecycle, scoring, stats
from listwright.schemas import LISTING, read_listings, registry
from listwright.sources import json_feeds, rss_feeds
from listwright.sources.registry import NORMALIZERS, normalize, register

NOW = dt.datetime(2024, 1, 31, 12, 0)
now = lambda: F.lit(NOW)


def values(spark, expr, cases, kind="string"):
    """expr over every input of cases {input: expected}; asserts all of them."""
    rows = [(i, v) for i, v in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expr(F.col("v")).alias("out"))
    got = {r.i: r.out for r in df.collect()}
    assert [got[i] for i in range(len(rows))] == [w for w in cases.values()]


def test_relative_dates(spark):
    day = dt.timedelta(days=1)
    values(spark, lambda v: s.parse_relative(v, now()), {
        "Today": NOW, "Just Now": NOW, "New": NOW, "newish": None, "Yesterday": NOW - day, "3 days ago": NOW - 3 * day,
        "2 weeks": NOW - 14 * day, "5 hours ago": NOW - dt.timedelta(hours=5), "1 month": NOW - 30 * day,
        "Featured": None, "": None, None: None,
    })


def test_dates(spark):
    values(spark, s.parse_iso, {
        "2024-01-02": dt.datetime(2024, 1, 2), "20240102": dt.datetime(2024, 1, 2),
        "2024-01-02T03:04:05.25Z": dt.datetime(2024, 1, 2, 3, 4, 5, 250000),
        "2024-01-02 03:04+0530": dt.datetime(2024, 1, 1, 21, 34), "2024-01-02T03:04:05-01:00": dt.datetime(2024, 1, 2, 4, 4, 5),
        "2024": None, "2024-01": None, "12:00": None, "2024-13-01": None, "soon": None, "": None, None: None,
    })
    values(spark, s.parse_feed_date, {
        "Tue, 02 Jan 2024 10:00:00 GMT": dt.datetime(2024, 1, 2, 10), "2 Jan 2024 10:00:00 +0200": dt.datetime(2024, 1, 2, 8),
        "Tue, 02 Jan 2024 10:00:00 PST": dt.datetime(2024, 1, 2, 18), "nonsense": None, None: None,
    })
    values(spark, s.parse_epoch, {0.0: dt.datetime(1970, 1, 1), 1.5: dt.datetime(1970, 1, 1, 0, 0, 1, 500000),
                                  -86400.0: dt.datetime(1969, 12, 31), 1e300: None}, "double")


def test_dates_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Karachi")
    try:
        values(spark, s.parse_iso, {"2024-01-02T03:04:05Z": dt.datetime(2024, 1, 2, 3, 4, 5)})
        values(spark, s.parse_feed_date, {"Tue, 02 Jan 2024 10:00:00 GMT": dt.datetime(2024, 1, 2, 10)})
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_money(spark):
    values(spark, s.compact_money, {
        0: None, -5: None, 999: "$999", 1000: "$1k", 2500: "$2k", 3500: "$4k", 180000: "$180k", 999999: "$1000k",
        1000000: "$1M", 1500000: "$1.5M", 1250000: "$1.2M", 1050000: "$1.1M", 1150000: "$1.1M", 1960000: "$2M", None: None,
    }, "bigint")
    values(spark, s.salary_in_text, {
        "pay $70 – $90/hour now": "$70 – $90/hour", "Range: $90,000  -  $95,000 per year": "$90,000 - $95,000 per year",
        "none": None,
    })
    values(spark, s.location_in_text, {
        "Location: Remote (EU only)\nJob Summary: x": "Remote (EU only)",
        "Title: X Location: Remote – based in Bergen Job Summary: y": "Remote – based in Bergen", "none": None,
    })


@pytest.mark.parametrize("slug,title,want", [
    ("quillworks-release-engineer-13", "Release Engineer", "Quillworks"),
    ("quill-works-trading-lead-13", "Trading Lead", "Quill Works"),
    ("folio-ai-private-clerk-wealth-13", "Private Clerk (Wealth)", "Folio AI"),
    ("acme-staff-engineer-amp-platform-9", "Staff Engineer & Platform", "Acme"),
    ("sponsored-job-at-home-recorder", "At-Home Recorder", None),
    ("release-engineer-13", "Release Engineer", None), ("", "Anything", None), ("a-b-c-d-e-f-engineer-1", "Engineer", None),
])
def test_company_from_slug(spark, slug, title, want):
    df = spark.createDataFrame([(slug, title)], "s string, t string")
    assert df.select(s.company_from_slug(F.col("s"), F.col("t"))).first()[0] == want


def test_texts(spark):
    values(spark, strip, {"  x \n": "x", "": ""})
    values(spark, clean_tags, {(" a", "A", "", None, "b "): ["a", "b"]}, "array<string>")
    values(spark, s.csv_safe, {"=1": "'=1", "+": "'+", "a=": "a=", None: "", "\tx": "'\tx"})
    values(spark, s.safe_link, {" HTTPS://x ": "HTTPS://x", "javascript:x": "#", None: "#"})
    values(spark, lambda v: s.extract_emails(v), {
        "Mail A.B@acme.test. or a.b@ACME.test, noreply@acme.test x@cdn.example.com pic@2x.png": ["a.b@acme.test"],
        " ".join(f"p{i}@acme.test" for i in range(7)): [f"p{i}@acme.test" for i in range(7)], "": [], None: [],
    })
    values(spark, lambda v: s.extract_emails(v, limit=2), {"a@acme.test b@acme.test c@acme.test": ["a@acme.test", "b@acme.test"]})
    values(spark, s.seniority, {
        "Head of Things": "lead", "Sr. Clerk": "senior", "Sr Clerk": "senior", "Srx Clerk": "mid", "jr.dev": "junior", "entry-level": "junior",
        "internal": "mid", "seniority": "mid",
    })
    values(spark, lambda v: s.required_years(v, F.lit("")), {
        "5+ years of experience": 5, "experience: 3 yrs": 3, "100+ years of experience": None, "2 years. experience": None,
        "1-2 years exp and experience of 7 years": 7, "ten years": None, "31 years experience": None,
    })


def test_sql_functions_agree_with_columns(spark):
    from listwright.functions.sql import register_sql_functions

    register_sql_functions(spark)
    ages = [0, 59, 60, 3599, 3600, 86399, 86400, 86400 * 29, 86400 * 31, 86400 * 364, 86400 * 800, -5]
    rows = [(i, NOW - dt.timedelta(seconds=a), u) for i, (a, u) in enumerate(zip(ages, ["\t HTTPS://x\n", "ftp:y", None] * 4))]
    df = spark.createDataFrame([(None, None, "http:/z"), *rows], "score int, ts timestamp_ntz, url string")
    as_of = f"timestamp_ntz'{NOW}'"
    both = df.select(
        F.array(F.expr("score_band(score)"), F.expr("safe_link(url)"), F.expr("dedupe_key(url)"),
                F.expr(f"relative_age(ts, {as_of})")).alias("sql"),
        F.array(s.score_band("score"), s.safe_link("url"), s.dedupe_key("url"), s.relative_age("ts", now())).alias("column"),
    ).collect()
    assert len(both) == 13 and all(r["sql"] == r["column"] for r in both)


def test_title_splits(spark):
    values(spark, lambda v: F.array(*s.title_company_location(v)), {
        "Dev - Acme - Oslo": ["Dev", "Acme", "Oslo"], "A - B - Acme - Oslo": ["A - B", "Acme", "Oslo"],
        "Dev - Acme": ["Dev", "Acme", None], "Dev": ["Dev", None, None],
    })
    values(spark, lambda v: F.array(*s.company_and_position(v)), {
        "Acme: Dev: II": ["Acme", "Dev: II"], ": Dev": [None, ": Dev"], "Dev": [None, "Dev"],
    })


def test_model_replies(spark):
    values(spark, s.parse_reply, {
        '{"score": 8.5, "reason": " ok "}': (8, "ok", "", None), '{"score": "7.5"}': (8, "", "", None),
        '```json\n{"score": 14, "proposal": "Hi"}\n```': (10, "", "Hi", None), '{"score": -3}': (0, "", "", None),
        '{"reason": "x"}': (None, None, None, "score missing"), '{"score": "high"}': (None, None, None, "score invalid"),
        "no": (None, None, None, "not json"), '{"score": "NaN"}': (None, None, None, "score invalid"),
    })


# ------------------------------------------------------------------ ingest
RAW = "cycle_id long, source string, external_id string, url string, title string, company string, description string, " \
      "tags array<string>, budget string, location string, posted_at timestamp_ntz, item_ord long"


def raw(spark, *rows):
    return spark.createDataFrame(
        [(1, src, None, url, title, None, desc, None, None, None, None, i) for i, (src, url, title, desc) in enumerate(rows)], RAW
    )


def test_gated_copy_does_not_block_a_later_one(spark):
    rows = raw(spark, ("remoteok", "http://A/1", "Painter", ""), ("hn", " http://a/1 ", " Python Dev ", ""),
               ("wwr", "http://a/1", "Python Dev", "unpaid"), ("hn", "", "Python", ""), ("rozee", "http://a/2", "Anything", None),
               ("rozee", "http://a/3", "Unpaid thing", ""), ("manual", "http://a/2", "Python", ""), ("wwr", "http://k/1", "Python", ""))
    known = spark.createDataFrame([("http://K/1",)], "url string").select(s.dedupe_key("url").alias("dedupe_hash"))
    new = {r.url: r for r in ingest.new_listings(rows, known, ingest.IngestConfig(), now()).collect()}
    assert {u: (r.source, r.title) for u, r in new.items()} == {
        "http://a/1": ("hn", "Python Dev"), "http://a/2": ("rozee", "Anything"),
    }
    summary = {r.source: r for r in ingest.cycle_summary(rows, known, ingest.IngestConfig()).collect()}
    total = summary["(all)"]
    assert (total.fetched, total.inserted, total.skipped) == (8, 2, 6)
    assert (total.skipped_no_url, total.skipped_gated, total.skipped_duplicate) == (1, 3, 2)
    assert sum(r.fetched for k, r in summary.items() if k != "(all)") == 8


def test_keyword_edges(spark):
    words = ["ai", "next.js", "api", "c++"]
    values(spark, lambda v: p.passes_keywords(F.lower(v), words), {
        "AI": True, "email training": False, "APIs": True, "api2": True, "apij": False, "next.js": True, "nextxjs": False,
        "éai": False, "c++": True, "ai_x": False,
    })
    values(spark, lambda v: p.passes_keywords(v, []), {"x": True})
    values(spark, lambda v: p.passes_keywords(v, [" "]), {"x": False})


def test_hot_address_is_reduced_before_the_shuffle(spark):
    """Half of all rows share one address; the plan limits them per task, and it is right."""
    rows = spark.range(20_000).select(
        F.lit(1).cast("long").alias("cycle_id"), F.lit("wwr").alias("source"), F.lit(None).cast("string").alias("external_id"),
        F.when(F.col("id") % 2 == 0, "http://hot/").otherwise(F.concat(F.lit("http://x/"), "id")).alias("url"),
        F.lit("Python").alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("description"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("budget"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        F.col("id").alias("item_ord"),
    )
    new = ingest.new_listings(rows, None, ingest.IngestConfig(), now())
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert new.count() == 10_001
    assert new.filter("url = 'http://hot/'").first().item_ord == 0


def test_dedupe_is_idempotent(spark):
    rows = raw(spark, *[("hn", f"http://a/{i % 5}", "Python", "") for i in range(20)])
    once = ingest.new_listings(rows, None, ingest.IngestConfig(), now())
    again = ingest.new_listings(rows, once.select("dedupe_hash"), ingest.IngestConfig(), now())
    assert once.count() == 5 and again.count() == 0


def test_number_rows(spark):
    rows = number_rows(spark.range(1000).repartition(7), [F.desc("id")], "n", start=5)
    got = {r.id: r.n for r in rows.collect()}
    assert got == {i: 5 + 999 - i for i in range(1000)}


# ------------------------------------------------------------------ lifecycle
def log(spark, *rows):
    """(job, minute, kind, status/text, score)"""
    full = [(j, NOW + dt.timedelta(minutes=m), n, k, v if k == "move" else None, None if k == "move" else v, sc, None)
            for n, (j, m, k, v, sc) in enumerate(rows)]
    return spark.createDataFrame(full, lifecycle.EVENT_SCHEMA)


def test_status_fold(spark):
    events = log(
        spark, (1, 0, "move", "applied", None), (1, 5, "move", "replied", None), (1, 9, "move", "applied", None),
        (2, 0, "move", "applied", None), (2, 3, "apply", None, None), (2, 7, "move", "applied", None), (2, 8, "ignore", None, None),
        (3, 0, "move", "nonsense", None), (4, 2, "shortlist", None, None), (4, 2, "move", "won", None),
    )
    at = lambda m: NOW + dt.timedelta(minutes=m)
    got = {r.job_id: (r.status, r.applied_at) for r in lifecycle.fold_status(events).collect()}
    assert got == {1: ("applied", at(0)), 2: ("ignored", at(3)), 4: ("won", None)}


def listing(spark, *rows):
    """Listing rows from dicts; everything else NULL or neutral."""
    base = {"status": "new", "ai_attempts": 0, "notes": "", "title": "T", "url": "http://u", "description": "", "source": "hn",
            "fetched_at": NOW, "tags": []}
    data = [tuple({**base, **r}.get(f.name) for f in LISTING) for r in rows]
    return spark.createDataFrame(data, LISTING)


def test_current_state(spark):
    events = log(
        spark, (1, 0, "proposal", "mine", None), (1, 1, "score", "model's", 7), (2, 0, "score", "model's", 4),
        (2, 1, "rescore", "again", 9), (3, 0, "score_failed", None, None), (3, 1, "score_failed", None, None),
        (4, 0, "score_failed", None, None), (4, 1, "rescore", "x", 1), (4, 2, "score_failed", None, None),
        (5, 0, "score", "model's", 3), (6, 0, "move", "applied", None), (7, 0, "notes", "n1", None), (7, 1, "notes", "", None),
        (8, 0, "proposal", "", None), (8, 1, "score", "model's", 2),
    )
    base = listing(spark, *[{"id": i} for i in (1, 2, 3, 4, 8, 9)], {"id": 5, "ai_proposal": "written"},
                   {"id": 6, "applied_at": NOW - dt.timedelta(days=1)}, {"id": 7, "notes": "old"})
    got = {r.id: r for r in lifecycle.current_state(base, events).collect()}
    assert (got[1].ai_proposal, got[1].ai_score) == ("mine", 7)
    assert (got[2].ai_proposal, got[2].ai_score, got[2].ai_attempts) == ("again", 9, 0)
    assert (got[3].ai_attempts, got[4].ai_attempts) == (2, 1)
    assert got[5].ai_proposal == "written"
    assert (got[6].status, got[6].applied_at) == ("applied", NOW - dt.timedelta(days=1))
    assert (got[7].notes, got[8].ai_proposal, got[9].status) == ("", "model's", "new")
    counts = {r.status: r.n for r in lifecycle.board_counts(lifecycle.current_state(base, events)).collect()}
    assert counts == {"new": 8, "applied": 1, "shortlisted": 0, "replied": 0, "interview": 0, "won": 0, "lost": 0}


def test_board_is_sorted(spark):
    rows = listing(spark, {"id": 1, "status": "won"}, {"id": 2}, {"id": 3, "applied_at": NOW + dt.timedelta(days=1)},
                   {"id": 4, "status": "ignored"}, {"id": 5})
    assert [r.id for r in lifecycle.board(rows).collect()] == [3, 2, 5, 1]


# ------------------------------------------------------------------ feed
def test_feed_requests(spark):
    rows = listing(spark, {"id": 1, "ai_score": 3}, {"id": 2, "ai_score": 9, "source": "wwr"}, {"id": 3, "status": "ignored"},
                   {"id": 4, "title": "Junior contractor"})
    ids = lambda **kw: [r.id for r in feed.listing_feed(rows, feed.FeedRequest(**kw), now()).collect()]
    assert ids() == [2, 1, 4]
    assert ids(sources=["wwr"]) == [2]
    assert ids(sources_shown=True) == []
    assert ids(status="all", min_score=0) == [2, 1, 3, 4]
    assert ids(freelance=True) == [4] and ids(employment=["contract"]) == [4] and ids(levels=["entry"]) == [4]
    assert ids(employment=["unknown"]) == [2, 1, 4] and ids(region="nowhere") == [2, 1, 4]
    assert ids(low_match_below=6) == [2, 4, 1]
    assert ids(q="contractor") == [4]


@pytest.mark.parametrize("n", [0, 1, 25, 26, 60])
def test_pages_are_the_whole_result(spark, n):
    rows = spark.range(n)
    info = feed.page_info(rows, 99).first()
    assert (info.total, info.pages, info.page) == (n, max(1, -(-n // 25)), max(1, -(-n // 25)))
    pages = [[r.id for r in feed.take_page(rows, [F.asc("id")], k).collect()] for k in range(1, info.pages + 1)]
    assert sum(map(sorted, pages), []) == list(range(n))
    assert sorted(r.id for r in feed.take_page(rows, [F.asc("id")], 99).collect()) == sorted(pages[-1])


def test_spines_are_complete(spark):
    rows = listing(spark, {"id": 1}, {"id": 2, "source": "legacy", "applied_at": NOW})
    days = stats.listings_per_source_day(rows, now()).collect()
    assert len(days) == 2 * 14 and sum(r.n for r in days) == 2
    assert {r.source: r.label for r in days} == {"hn": "Hacker News", "legacy": "legacy"}
    weeks = stats.applications_per_week(rows, now()).collect()
    assert len(weeks) == 8 and sum(r.n for r in weeks) == 1 and all(r.week.weekday() == 0 for r in weeks)
    assert len(stats.applications_per_week(rows.limit(0), now()).collect()) == 8
    empty = stats.funnel(rows.limit(0)).first()
    assert (empty.total_jobs, empty.reply_rate) == (0, 0)


def test_alert_text_is_cut(spark):
    rows = listing(spark, {"id": 1, "ai_score": 0, "ai_reason": "r" * 5000}, {"id": 2, "ai_score": 9, "notified_at": NOW})
    (r,) = alerts.select_alerts(rows, threshold=0, max_chars=3900).collect()
    assert r.id == 1 and len(r.message) == 3900 and r.message.endswith("…") and r.message.startswith("⭐ 0/10 — T\nrrr")


def test_export_files(spark, tmp_path):
    rows = listing(spark, {"id": 1, "title": '=cmd "x", y', "status": "won"}, {"id": 2, "status": "ignored"})
    export.write_export(rows, str(tmp_path / "out"))
    (back,) = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "out")).collect()
    assert back.title == '\'=cmd "x", y' and back.fetched_at == "2024-01-31T12:00:00" and len(back) == 12


def test_late_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = listing(spark, {"id": 1, "title": "mail a@acme.test"})
    rows.drop("ai_attempts", "contact_emails", "notified_at").write.parquet(path)
    rows.withColumn("id", F.lit(2).cast("long")).write.mode("append").parquet(path)
    got = {r.id: r for r in ingest.backfill_emails(read_listings(spark, path)).collect()}
    assert got[1].ai_attempts == 0 and got[1].contact_emails == ["a@acme.test"] and got[2].ai_attempts == 0


# ------------------------------------------------------------------ profiles and matching
def test_profile_files(spark, tmp_path):
    for name, data in {"a.txt": "  Rust \n".encode(), "b.md": b"caf\xff\xc3\xa9", "c.txt": b"  ", "d.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit('/', 1)[-1]: (r.text, r.error) for r in match.read_profile_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Rust", None), "b.md": ("café", None), "c.txt": (None, "no text"), "d.pdf": (None, "unsupported file type")}


def test_matching_one_and_many(spark):
    rows = listing(spark, {"id": 1, "title": "C++11 and React Native"}, {"id": 2, "title": "node"}, {"id": 3, "tags": ["Go"]},
                   {"id": 4, "title": "Java", "status": "ignored"}, {"id": 5, "title": "cargo javascript ++"})
    skills = ["React", "react native", "C++", "go", "java", "++", " React "]
    one = {r.id: r.hits for r in match.match_profile(rows, skills).collect()}
    assert one == {1: ["react", "react native", "c++", "++"], 3: ["go"], 5: ["++"]}
    profiles = spark.createDataFrame([("p", skills), ("q", ["node"])], "profile_id string, skills array<string>")
    many = {(r.profile_id, r.id): r.hits for r in match.match_profiles(rows, profiles).collect()}
    assert many == {**{("p", i): h for i, h in one.items()}, ("q", 2): ["node"]}


def test_scorer_round_trip(spark):
    queue = scoring.scoring_queue(listing(spark, {"id": 1, "title": "python api"}, {"id": 2, "ai_attempts": 5}, {"id": 3, "ai_score": 2}))
    replies = scoring.overlap_replies(queue, ["python", "api"])
    folded = scoring.fold_replies(queue, replies).collect()
    assert [(r.id, r.ai_score, r.ai_reason) for r in folded] == [(1, 10, "Skills found: python, api")]
    (event,) = scoring.score_log_events(replies, now()).collect()
    assert (event.kind, event.score) == ("score", 10)


# ------------------------------------------------------------------ sources
def test_malformed_items_are_skipped(spark, landing):
    body = json.dumps({"jobs": ["x", None, 5, {"url": "http://a", "title": ["no"]}, {"url": "", "title": "t"},
                                {"url": "http://b", "title": " ok ", "tags": "one", "publication_date": 86400}]})
    rows = json_feeds.remotive(landing(("remotive", "0", body), ("remotive", "1", "oops"), ("remotive", "2", "[1]"))).collect()
    (ok,) = [r for r in rows if r.title == "ok"]
    assert ok.tags == ["one"] and ok.posted_at == dt.datetime(1970, 1, 2) and ok.item_ord == 5


def test_failed_responses_give_nothing(spark, landing):
    body = json.dumps({"jobs": [{"url": "http://b", "title": "ok"}]})
    assert json_feeds.remotive(landing(("remotive", "0", body), status=403)).count() == 0
    failures = ingest.source_failures(landing(("remotive", "0", body), status=403).unionByName(landing(("hn", "0", ""), status=502)))
    assert {r.source: (r.error_class, r.error) for r in failures.collect()} == {
        "remotive": ("blocked", "HTTP 403"), "hn": ("failed", "HTTP 502")}


def test_thread_choice(spark, landing):
    def thread(*hits):
        body = json.dumps({"hits": [dict(zip(("objectID", "author", "title"), h)) for h in hits]})
        return [r.story_id for r in json_feeds.hn_thread(landing(("hn", "search", body))).collect()]

    assert thread(("1", "x", "Ask HN: Who is hiring"), ("2", "whoishiring", "Ask HN: Who is hiring? (May)")) == ["2"]
    assert thread(("1", "x", "Who is hiring"), ("2", "y", "ASK HN: who is hiring")) == ["2"]
    assert thread(("1", "x", "Something")) == []


def test_broken_feed(spark, landing):
    assert rss_feeds.wwr(landing(("wwr", "0", "<rss><chan"))).count() == 0


def test_registry(spark, landing):
    known = [r.source for r in registry(spark).orderBy("source_ord").collect()]
    assert known[:-1] == list(NORMALIZERS) and known[-1] == "manual" and len(known) == 22
    register("mine", json_feeds.remotive)
    try:
        assert normalize(landing(("remotive", "0", "{}")), ["mine"]).count() == 0
    finally:
        del NORMALIZERS["mine"]


def _brute_match(listings, profiles, min_hits=1):
    import re

    out = {}
    for profile_id, skills in profiles:
        wanted = match.clean_skills(skills)
        for i, title, description, tags, status in listings:
            text = f"{title or ''}\n{description or ''}\n{' '.join(tags or [])}".lower()
            hits = [s for s in wanted if re.search(
                ("(?<!\\w)" if s[0].isalnum() else "") + re.escape(s) + ("(?!\\w)" if s[-1].isalnum() else ""), text)]
            if status != "ignored" and len(hits) >= min_hits and hits:
                out[profile_id, i] = hits
    return out


@pytest.mark.parametrize("split", [100_000, 7])
@pytest.mark.parametrize("min_hits", [1, 2])
def test_rarest_skill_join(spark, monkeypatch, split, min_hits):
    """One skill in every listing, one in none, equal sets, repeated and blank skills; heavy skills split or not."""
    import random

    monkeypatch.setattr(match, "SPLIT_ROWS", split)
    rng = random.Random(8)
    words = ["python", "c++", ".net", "node.js", "machine learning", "365", "go", "x_y", "full-stack", "rust"]
    listings = [
        (i, "hot " + " ".join(rng.sample(words, rng.randint(0, 4))), rng.choice(words + ["C++11", "gopher", "machine  learning"]),
         [rng.choice(words)] if i % 3 else None, "ignored" if i % 9 == 0 else "new")
        for i in range(60)
    ]
    profiles = [(p, rng.sample(words, rng.randint(1, 6)) + ["HOT "] * (p % 3 > 0)) for p in range(12)]
    profiles += [(100, ["hot"]), (101, ["hot"]), (102, []), (103, [" ", ""]), (104, ["cobol"]), (105, ["Go", "go", "hot"]), (106, ["+", "++", "-"])]
    df = spark.createDataFrame(listings, "id long, title string, description string, tags array<string>, status string")
    people = spark.createDataFrame(profiles, "profile_id long, skills array<string>")
    got = match.match_profiles(df, people, min_hits=min_hits).collect()
    want = _brute_match(listings, [(p, s) for p, s in profiles], min_hits)
    assert {(r.profile_id, r.id): r.hits for r in got} == want
    assert len(got) == len(want) and all(r.hit_count == len(r.hits) for r in got)


def test_best_listings_of_each_profile(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, "python go" if i % 4 == 0 else "python", None, None, "new", i % 5, at, at) for i in range(40)]
    df = spark.createDataFrame(
        rows, "id long, title string, description string, tags array<string>, status string, ai_score int, "
        "posted_at timestamp_ntz, fetched_at timestamp_ntz")
    people = spark.createDataFrame([(1, ["python", "go"]), (2, ["python", "go"]), (3, ["python"])], "profile_id long, skills array<string>")
    got = {}
    for r in match.match_profiles(df, people, top=3).collect():
        got.setdefault(r.profile_id, set()).add(r.id)
    assert got[1] == got[2] == {4, 24, 8} and got[3] == {4, 9, 14}


@pytest.mark.parametrize("sorted_rows", [10_000, 10])
def test_deep_pages(spark, monkeypatch, sorted_rows):
    """Every page, with ties, NULLs and one value in a third of the rows; ranges are divided again or not."""
    monkeypatch.setattr(feed, "SORTED_ROWS", sorted_rows)
    rows = spark.range(190).select(
        "id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 7 > 0, F.col("id") % 11).alias("score"), F.lit("text").alias("note")
    )
    order = [F.desc_nulls_last("score"), F.asc("id")]
    want = [r.id for r in rows.orderBy(*order).collect()]
    for page in (1, 2, 5, 8, 9):
        got = feed.take_page(rows, order, page, size=25, reads=["score"])
        assert [r.id for r in got.collect()] == want[25 * min(page - 1, 7):][:25]
        assert got.columns == ["id", "score", "note"]
    assert feed.take_page(rows.limit(0), order, 4).collect() == []
    same = feed.take_page(rows.withColumn("score", F.lit(1)), [F.asc("score")], 3, size=25).collect()
    assert len({r.id for r in same}) == 25


def test_deep_pages_sort_a_range_only(spark, capfd):
    """The plan has neither a window nor a sort over all rows: the page is read by its keys."""
    rows = spark.range(1000).withColumn("score", F.col("id") % 10)
    page = feed.take_page(rows, [F.desc("score"), F.asc("id")], 30, size=25)
    capfd.readouterr()
    page.explain()
    plan = capfd.readouterr().out
    assert "Window" not in plan and "TakeOrderedAndProject" in plan and "IN" in plan.upper()
    assert page.count() == 25
