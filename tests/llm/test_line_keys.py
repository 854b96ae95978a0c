"""The segment keys of lines are dealt out once, and only what shares one is written."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from listwright.llm import line_dedup


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_across_batches(size):
    rng = random.Random(3)
    rows = sorted((rng.choice([-5, 1, 2, 3, 4, 5, 6, 7]), rng.randint(0, n), rng.random() < 0.4) for n in [3, 30] for _ in range(60))
    rows += [(9, k, True) for k in range(200)] + [(10, 1, True)] * 20 + [(11, 1, False), (11, 2, False)]
    nodes, indexed = {}, {}
    for key, short, own in rows:
        nodes.setdefault(key, set()).add(short)
        indexed[key, short] = indexed.get((key, short), False) or own
    small = 12
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c) for c in (np.array(k), np.array(s), np.array(i))], names=["key", "short", "indexed"])
        for k, s, i in (zip(*rows[at:at + size]) for at in range(0, len(rows), size))
    ]
    got = [r for b in line_dedup._met(small)(iter(batches)) for r in b.to_pylist()]
    crowded = {}
    for r in got:
        if r["key"] is not None:
            crowded[r["key"], r["a"]] = crowded.get((r["key"], r["a"]), False) or r["indexed"]
    assert crowded == {(k, s): own for (k, s), own in indexed.items() if len(nodes[k]) > small}
    want = [
        pair for k, own in nodes.items() if len(own) <= small
        for pair in combinations(sorted(own), 2) if indexed[k, pair[0]] or indexed[k, pair[1]]
    ]
    assert sorted((r["a"], r["b"]) for r in got if r["key"] is None) == sorted(want)


def test_unlike_lines_leave_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, "\n".join("".join(rng.choice("abcdefghijkl ") for _ in range(80)) for _ in range(5))) for k in range(100)]
    sizes, written = {}, line_dedup.written

    def counted(df, label):
        out = written(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    assert line_dedup.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert sizes and not any(sizes.values())
