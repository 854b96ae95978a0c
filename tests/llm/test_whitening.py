"""Whitening against numpy and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import whitening
from listwright.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, components=16):
    """rows: (id, list of numbers); whitened values up to the sign of each component."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    distinct = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = np.array(distinct * n - sums, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.max()]
    whitened = (np.array(x * n - sums, float) / n) @ (vectors[:, order] / np.sqrt(values[order]))
    return n, ((x * n - sums) ** 2).sum(axis=1), whitened, values[order] / values.sum()


def check(got, rows, components=16, distinct_values=True):
    n, deviation, whitened, explained = brute(rows, components)
    k = whitened.shape[1]
    assert len(got) == len(rows) * k
    assert {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    for c in range(k):
        # Rows with the same id are told apart by nothing: compare them as a sorted list.
        mine = sorted(((str(r["id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1), key=lambda t: t[:2])
        theirs = sorted(((str(i), d, w) for (i, _), d, w in zip(rows, deviation, whitened[:, c])), key=lambda t: t[:2])
        assert [t[:2] for t in mine] == [t[:2] for t in theirs]
        a, b = np.array([t[2] for t in mine]), np.array([t[2] for t in theirs])
        if distinct_values:
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert {round(r["explained"], 9) for r in got if r["component"] == c + 1} == {round(float(explained[c]), 9)}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op13_whitening"](spark, SF_DIR).withColumnRenamed("vec_id", "id").collect()
    check(got, rows)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(150, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    # A third of the rows are one vector; some share an id, some have none.
    return rows + [(1000, rows[0][1])] * 50 + [(1001 + i, rows[0][1]) for i in range(30)] + [(None, rows[3][1])]


def table_of(spark, rows):
    clashes = [F.lit("clash").alias(c) for c in ("id", "x", "m", "part", "block", "slab", "at", "n", "deviation", "row")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *clashes)


def test_odd_rows(spark, vectors):
    odd = [(1, None), (2, [1.0, None, 2.0, 3.0, 4.0]), (3, [float("nan")] * 5), (4, [float("inf")] + [0.0] * 4), (5, []),
           (6, [1.0, 2.0]), (None, None)]
    got = whitening.whiten(table_of(spark, vectors + odd)).collect()
    check(got, vectors)
    check(whitening.whiten(table_of(spark, vectors), components=2).collect(), vectors, 2)


def test_slabs(spark, vectors, monkeypatch):
    """Several slabs of several blocks each, the last block of a task filled up."""
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 5 * 7)
    monkeypatch.setattr(whitening, "SLAB", 2)
    check(whitening.whiten(table_of(spark, vectors).repartition(5)).collect(), vectors)


def test_fewer_directions(spark):
    """Entries that do not vary, or together: as many components as there are directions."""
    rows = [(i, [float(i), 2.0 * i, 7.0, float(i * i)]) for i in range(40)]
    check(whitening.whiten(table_of(spark, rows)).collect(), rows)


def test_nothing_to_whiten(spark):
    assert whitening.whiten(table_of(spark, [])).collect() == []
    assert whitening.whiten(table_of(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table_of(spark, [(1, []), (2, [])])).collect() == []
    assert whitening.whiten(table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_large_entries(spark):
    """Far entries are cut to 2^40; a deviation that no long holds is null."""
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(30)] + [(30, [1e300, -1e300])]
    got = whitening.whiten(table_of(spark, rows)).collect()
    assert {r["id"] for r in got} == set(range(31))
    assert [r["deviation"] for r in got if r["id"] == 30] == [None, None] or all(r["deviation"] is None for r in got if r["id"] == 30)
    large = [(i, [float(i * 10_000), float(i % 5)]) for i in range(30)]
    check(whitening.whiten(table_of(spark, large)).collect(), large)
