"""The pipeline's stages, one after the other, against plain Python."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from listwright.llm import decontamination, line_dedup, near_dedup, packing
from listwright.llm.common import written
from test_brute import SF_DIR, brute_dropped, brute_windows, roots


@pytest.fixture(scope="module")
def stages(spark, documents):
    """Documents before the first stage and after each: {name: {id: text}}; the last one's rows."""
    out, docs = {"start": {r["doc_id"]: r["text"] for r in documents.collect()}}, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), name)
        rows = docs.collect()
        assert docs.columns == documents.columns and len({r["doc_id"] for r in rows}) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        out[name] = {r["doc_id"]: r["text"] for r in rows}
    out["packing"] = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    return out


def test_clean_documents_pass_language_id(stages):
    gone = set(stages["start"]) - set(stages["language_id"])
    assert all(not any(c.isalpha() for c in stages["start"][i] or "") for i in gone)
    assert all(stages["start"][i] == t for i, t in stages["language_id"].items())


def test_lines(stages):
    before = stages["language_id"]
    want = {}
    for i, numbers in brute_dropped(sorted(before.items())).items():
        kept = "\n".join(line for k, line in enumerate(before[i].split("\n")) if k not in numbers)
        if not numbers or kept.strip(line_dedup.BLANKS + "\n"):
            want[i] = kept
    assert stages["line_dedup"] == want


def test_near_duplicates(stages):
    before = stages["line_dedup"]
    sets = {i: frozenset(near_dedup.ngrams(t).tolist()) for i, t in before.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for a, i in enumerate(ids) for b, j in enumerate(ids[:a])
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(ids), links)
    stays = {ids[r] for r in root} | {i for i in sets if not sets[i]}
    assert stages["near_dedup"] == {i: t for i, t in before.items() if i in stays}


def test_benchmark_passages_are_gone(spark, stages):
    items = [(str(r["item_id"]), decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    after = stages["decontamination"]
    for i, text in stages["near_dedup"].items():
        words = decontamination.words_of(text)
        hit, _ = brute_windows(items, words)
        if len(hit) > decontamination.MOST_COVERED * len(words):
            assert i not in after
        elif not hit:
            assert after[i] == text
        else:
            assert decontamination.words_of(after[i]) == [w for k, w in enumerate(words) if k not in hit]


def test_all_tokens_are_packed(stages):
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    sizes, sequences = defaultdict(int), defaultdict(list)
    for r in stages["packing"]:
        sizes[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sizes == {i: len(tokenizer.encode(t)) // 4 + 1 for i, t in stages["decontamination"].items()}
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
