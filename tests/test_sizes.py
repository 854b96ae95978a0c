"""Work that has to stay bounded, or spread, on large tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from checks import stored
from listwright.functions import html
from listwright.operators import search
from listwright.sources.landing import good_responses, read_landing, write_landing


def test_a_source_reads_its_own_responses_only(spark, landing, tmp_path):
    path = tmp_path / "landing"
    write_landing(landing(("rozee", "0", "a"), ("bayt", "0", "b")), str(path))
    (path / "source=bayt" / "broken.parquet").write_bytes(b"no table")
    assert [r.body for r in good_responses(read_landing(spark, str(path)), "rozee").collect()] == ["a"]


def test_pages_are_parsed_in_slices():
    pages = ["<p>a<br>b</p>", None, "", "x" * (3 << 20)] + ["<a href='/x'>y</a>"] * 2500
    nodes = list(html.html_nodes.func(iter([pa.array(pages)])))
    texts = list(html.html_to_text.func(iter([pa.array(pages)])))
    assert [len(x) for x in nodes] == [len(x) for x in texts] and len(nodes) > 3 and max(map(len, nodes)) <= 1000
    nodes, texts = (pa.chunked_array(x).to_pylist() for x in (nodes, texts))
    assert texts == ["a\nb", "", "", pages[3]] + ["y"] * 2500
    assert [len(n) for n in nodes] == [5, 0, 0, 2] + [3] * 2500 and nodes[-1][1]["href"] == "/x" and nodes[-1][2]["text"] == "y"
    none = pa.chunked_array(list(html.html_nodes.func(iter([pa.array([None, ""], pa.string())]))))
    assert none.to_pylist() == [[], []] and html._NODE_ARROW == none.type.value_type


def test_slices_in_a_query(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("<p>"), "id", F.lit("</p>")).alias("page")).coalesce(1)
    got = df.select("id", html.html_to_text("page").alias("text"), F.size(html.html_nodes("page")).alias("n"))
    assert got.filter("text <> id or n <> 3").count() == 0 and got.count() == 5000


def test_profile_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"n{i}", 3, "m") for i in range(1, 41)]
    rows = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(stored, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = {r.c_custkey: r.text for r in stored.profile_files(spark, str(tmp_path)).collect()}
    assert found == {i: None if i % 7 == 0 else f"n{i}\nm" for i in range(1, 41)}
    files = list((tmp_path / "profiles").rglob("part-*.txt"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1


def test_python_judges_neighbours_only(spark):
    """Words that cannot be neighbours are judged without Python, and the same."""
    fields = "role string, pos int, unit string, bit int, start int, j int, k int, n int, free_start boolean, free_end boolean, before string, lead_chars int, trail_chars int"
    row = lambda role, pos, bit, start, k=1, j=0, n=2: (role, pos, f"u{pos}", bit, start, j, k, n, True, True, "a ", 0, 0)
    groups = {
        "apart": [row("term", 0, 8, 0), row("term", 1, 4, 0), row("neighbour", 0, 8, 0), row("neighbour", 1, 4, 0)],
        "twice": [row("term", 0, 8, 0), row("term", 0, 1, 5), row("neighbour", 0, 8, 0), row("neighbour", 0, 8, 3)],
        "excluded": [row("term", 1, 8, 0), row("exclude", 0, 8, 2)],
        "only": [row("exclude", 0, 8, 2, n=0)],
        "near": [row("term", 0, 8, 0), row("term", 1, 8, 1), row("neighbour", 0, 8, 0), row("neighbour", 1, 8, 1)],
        "words": [row("term", 0, 8, 0, 2, 0), row("term", 0, 8, 0, 2, 1), row("term", 1, 8, 4, 2, 0)],
    }
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], f"g string, {fields}")
    df = df.groupBy("g").agg(F.collect_list(F.struct(*df.columns[1:])).alias("rows"), search._may_be_near().alias("near"))
    got = {r.g: r for r in df.select("g", "near", search._verdict().alias("v")).collect()}
    assert {g for g, r in got.items() if r.near} == {"near", "words"}
    names = [f.split()[0] for f in fields.split(", ")]
    for g, rows in groups.items():
        assert got[g].v.asDict() == search._judged([dict(zip(names, r)) for r in rows]), g
