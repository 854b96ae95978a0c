"""The check of all sources holds the responses of one source at a time, made of listings that were dealt out once."""

import datetime

import pytest

from checks import sources
from checks.base import QUERIES

NAMES = ["remoteok", "wwr", "hn", "wellfound"]


@pytest.fixture
def tables(spark, tmp_path):
    day = datetime.datetime(2024, 1, 2, 3, 4, 5)
    docs = [(i, f"text <{i}> & more") for i in range(130)] + [(7, "again"), (7, "again"), (51, None)]
    events = [(i, day, i * 3, "click", float(i)) for i in range(0, 130, 2)] + [(7, day, 1, "signup", 2.0), (None, day, 4, None, None)]
    turns = [(i, 0, "user", f"turn {i}") for i in range(70)] + [(3, 0, "user", "turn"), (None, 1, "user", "remote")]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string"),
        ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
        ("conversations", turns, "conv_id long, turn int, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    scratch = tmp_path / "scratch"
    scratch.mkdir()
    return str(tmp_path / "in"), scratch


def _in(scratch, monkeypatch):
    made = []

    def path(spark, label):
        made.append(label)
        return str(scratch / f"{label}-{len(made)}")

    monkeypatch.setattr(sources, "scratch_path", path)


def test_one_source_lands_at_a_time(spark, tables, monkeypatch):
    d, scratch = tables
    _in(scratch, monkeypatch)
    landed, write = [], sources.write_landing

    def seen(landing, path):
        write(landing, path)
        landed.append([p.name for p in scratch.glob("all-landing-*/source=*")])

    monkeypatch.setattr(sources, "write_landing", seen)
    monkeypatch.setattr(sources, "ALL_SOURCES", NAMES)
    got = {r["source"]: (r["n"], r["rows_hash"]) for r in QUERIES["normalize_all"](spark, d).collect()}
    assert landed == [[f"source={n}"] for n in NAMES]
    assert list(scratch.iterdir()) == []
    assert {n: got[n][0] for n in NAMES} == {n: QUERIES[f"normalize_{n}"](spark, d).count() for n in NAMES}


def test_dealt_listings_make_the_same_responses_without_a_shuffle(spark, tables, monkeypatch):
    d, scratch = tables
    _in(scratch, monkeypatch)
    for name in ("remoteok", "wwr"):
        want = sorted(map(str, sources.BUILDERS[name](spark, d).collect()))
        with sources.dealt(spark, d) as folder:
            feed = sources.BUILDERS[name](spark, folder)
            assert sorted(map(str, feed.collect())) == want and len(want) == 3
            assert "Exchange" not in feed._jdf.queryExecution().executedPlan().toString()
