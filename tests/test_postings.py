"""The positional index: what words say, what stands around them, and forms found by their positions."""

import re

import pytest

from listwright.operators import postings as p


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)


def test_words_with_their_gaps(spark):
    rows = p.postings(table(spark, " Web,  Dev_1 ", None, "", "--", "x"), {1: "text"}).collect()
    got = {(r.id, r.pos): (r.bit, r.word, r.piece.replace(p._OTHER, "~")) for r in rows}
    assert got == {
        (0, 0): (1, "web", " web,  ~"), (0, 1): (1, "dev", "~,  dev_~"), (0, 2): (1, "1", "~_1 "), (4, 0): (1, "x", "x"),
    }


def test_marks_in_a_text_are_no_marks(spark):
    rows = p.postings(table(spark, "a\x01b\x03c"), {1: "text"}).collect()
    assert [r.word for r in sorted(rows, key=lambda r: r.pos)] == ["a", "b", "c"]
    assert all("\x01" not in r.piece for r in rows)


def test_forms_are_taken_apart():
    one = p.runs_of("API", p.LOOSE)
    assert [(r["word"], r["exact"]) for r in one] == [("api", True), ("apis", True), ("apies", True), ("apijs", True), ("api", False)]
    first, last = p.runs_of("c++ developer", p.FREE)
    assert (first["word"], first["gap"], first["k"]) == ("c", "free", 2) and (last["gap"], last["gap_text"]) == ("equal", "a++ ")
    assert p.runs_of("++", p.FREE) == [] == p.runs_of("", p.LOOSE)
    assert p.runs_of(".net", p.LITERAL)[0]["lead_chars"] == 1


FORMS = ["web dev", "c++", ".net", "a_b", "365", "node.js", "web", "x"]
TEXTS = ["web dev", "web  dev", "webdev", "a web-dev web dev", "C++ and .NET", "asp.net c++11", "a_b", "xa_b", "3650 365", "node.js nodejs",
         "_web", "web_", "web web web dev", None, "", "365"]


def test_free_forms_are_where_patterns_are(spark):
    forms = spark.createDataFrame([(f, f, p.FREE) for f in FORMS], "unit string, form string, mode string")
    got = {(r.id, r.unit) for r in p.find_forms(p.postings(table(spark, *TEXTS), {1: "text"}), forms).collect()}
    want = set()
    for i, text in enumerate(TEXTS):
        for f in FORMS:
            start, end = ("(?<!\\w)" if f[0].isalnum() else ""), ("(?!\\w)" if f[-1].isalnum() else "")
            if re.search(start + re.escape(f) + end, (text or "").lower()):
                want.add((i, f))
    assert got == want


def test_forms_without_words(spark):
    forms = spark.createDataFrame([(f, f) for f in ("++", "+", "->", "web", "")], "unit string, form string")
    got = {(r.id, r.unit) for r in p.find_marks(table(spark, "c++", "a -> b", "+", None, "web"), "text", forms).collect()}
    assert got == {(0, "++"), (0, "+"), (1, "->"), (2, "+")}


@pytest.mark.parametrize("word,longest,keys", [("k812", 9, ["k812", "k", "k8", "k81"]), ("3651", 2, ["3651", "3", "36"]), ("web", 9, ["web"]),
                                              ("٣٤", 9, ["٣٤", "٣"]), ("a1b", 9, ["a1b"])])
def test_digits_are_looked_up_by_stems(spark, word, longest, keys):
    row = spark.createDataFrame([(word,)], "word string").select(p._keys(longest).alias("k")).first()
    assert [k.removesuffix(p._CUT) for k in row.k] == keys
