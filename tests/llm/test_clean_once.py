"""Taking out benchmark passages is one pass through Python, with the same results as finding them and cutting."""

import re

import pytest

from listwright.llm import decontamination

SCHEMA = "doc_id long, text string, cleaned string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i1", "five six seven"), ("i2", "two three"), ("i3", None)], "item_id string, text string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "One, TWO three! four five six seven.", "own"), (1, "One, TWO three! four five six seven.", "own"), (2, "two three", None),
        (3, None, None), (4, "", None), (None, "a b two three c d", "own"), (5, "five six seven eight nine ten eleven", None), (6, "clean", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_one_python_worker_a_task(docs, items):
    plan = decontamination.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1


@pytest.mark.parametrize("block_words", [500_000, 2])
def test_cleaned(docs, items, monkeypatch, block_words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block_words)
    got = decontamination.decontaminate(docs, items)
    assert got.columns == docs.columns
    want = [(3, None, None), (4, "", None), (None, "a b  c d", "own"), (5, " eight nine ten eleven", None), (6, "clean", None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    all_kept = decontamination.decontaminate(docs, items, most_covered=1.0).filter("doc_id = 1").collect()
    assert [r["text"] for r in all_kept] == ["One, ! four ."] * 2
