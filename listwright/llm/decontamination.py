"""Benchmark decontamination with a generalised suffix automaton.

The items' words, as numbers, are put into one automaton, which then has a state for every set of places where some
word sequence occurs in the items. A document's words are streamed through it; after each word the automaton knows the
longest run ending there that occurs in an item, and so which windows of the items end there.

The automaton is built for a block of items of at most BLOCK_WORDS words at a time; a larger benchmark makes more blocks,
and each document passes through all of them in turn. So what is broadcast has a bound that does not depend on the
benchmark, and documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import LOWER, UPPER, WORD, query, table
from listwright.session import keep_computed

#: Words of a window.
WINDOW = 10
#: Items of so many words together make a block; a single longer item is a block of its own.
BLOCK_WORDS = 500_000
#: A document of which more than this share of words is hit goes as a whole.
MOST_COVERED = 0.5

_WORD = re.compile(WORD)
_LOWERED = str.maketrans(UPPER, LOWER)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWERED)) if text else []


class ItemAutomaton:
    """A generalised suffix automaton of word sequences, with the windows of each item marked."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: Items with a full window that ends in the state; and shorter items: (length, item), which are their own window.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                self.short.setdefault(state, set()).add((len(words), item))
            for state in self._ends(words):
                self.full.setdefault(state, set()).add(item)
        self._inherit()

    def _extend(self, last: int, word: str) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._new({}, self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p == -1:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _new(self, edges: dict[str, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The shorter sequences of ``q``, which occur in more places, become a state of their own."""
        copy = self._new(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _step(self, state: int, matched: int, word: str) -> tuple[int, int]:
        edges = self.next
        while word not in edges[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return edges[state][word], matched + 1

    def _window_state(self, state: int) -> int:
        """The state whose sequences include the last ``window`` words of the ones of ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _ends(self, words: list[str]) -> Iterator[int]:
        state = matched = 0
        for word in words:
            state, matched = self._step(state, matched, word)
            if matched >= self.window:
                yield self._window_state(state)

    def _inherit(self) -> None:
        """Short items also end where a longer sequence ends with them: each state takes on its links' marks."""
        if not self.short:
            return
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if above := self.short.get(self.link[state]):
                self.short[state] = self.short.get(state, set()) | above

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, [start, end) by start and apart from each other; items with occurring windows)."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        edges, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        root = edges[0]
        for at, word in enumerate(words):
            to = edges[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            elif word not in root:
                state = matched = 0
                continue
            else:
                while word not in edges[state]:
                    state = link[state]
                matched = length[state] + 1
                state = edges[state][word]
            longest = 0
            if matched >= window:
                items |= self.full[self._window_state(state)]
                longest = window
            if short and state in short:
                for n, item in short[state]:
                    if n <= matched:
                        items.add(item)
                        longest = max(longest, n)
            if longest:
                start = at + 1 - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, items


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, list[str]]]]:
    """The items in blocks for the driver, one at a time. Items with a null id or no words have no windows to report."""
    items = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")
    )
    block: list[tuple[str, list[str]]] = []
    size = 0
    for row in items.toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["id"], words))
        size += len(words)
    if block:
        yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("items", pa.list_(pa.string())),
])


def _shared_automata(spark: SparkSession, benchmark: DataFrame) -> list[Broadcast]:
    shared = [spark.sparkContext.broadcast(ItemAutomaton(block)) for block in item_blocks(benchmark)]
    return shared or [spark.sparkContext.broadcast(ItemAutomaton([]))]


def _found_in(automata: list[ItemAutomaton], words: list[str]) -> dict:
    """What the column contamination says of a document's words."""
    spans, items = automata[0].scan(words)
    for automaton in automata[1:]:
        more, others = automaton.scan(words)
        spans, items = _merged(spans + more), items | others
    return {"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items)}


def _scan(shared: list[Broadcast]):
    @F.arrow_udf(_FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [s.value for s in shared]
        for texts in batches:
            yield pa.array([_found_in(automata, words_of(text.as_py())) for text in texts], _FOUND_ARROW)

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column contamination: STRUCT<n_words, spans of hit words, items>.

    A window is WINDOW consecutive words of an item; an item of fewer words is one window. A word inside an occurrence of
    a window is hit. Words are numbered from 0, spans end before ``end``, items are sorted as strings. Null and empty
    texts have no words. Repeated items count once for each id. An empty benchmark hits nothing. Repeated documents each
    get the same. A column contamination that was there before is replaced.
    """
    scan = _scan(_shared_automata(docs.sparkSession, benchmark))
    return docs.withColumn("contamination", scan(F.col(text_col)))


def _without_spans(text: str | None, spans: list[dict[str, int]]) -> str | None:
    """The text without the words of the spans and what stands between them; the rest stays as it is."""
    if not text or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWERED))]
    kept, at = [], 0
    for cut in spans:
        kept.append(text[at:places[cut["start"]][0]])
        at = places[cut["end"] - 1][1]
    return "".join(kept) + text[at:]


_CLEANED = f"contamination struct<{_FOUND}>, text string"
_CLEANED_ARROW = pa.struct([("contamination", _FOUND_ARROW), ("text", pa.string())])


def _clean(shared: list[Broadcast], most_covered: float):
    """What was found in a text and the text without it; null where more than the limit is hit.

    Scan, limit and cut are one function: each of its own would take a Python worker of its own in every task.
    """
    @F.arrow_udf(_CLEANED)
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [s.value for s in shared]
        for texts in batches:
            out = []
            for text in texts:
                text = text.as_py()
                found = _found_in(automata, words_of(text))
                n_hit = sum(s["end"] - s["start"] for s in found["spans"])
                goes = n_hit > found["n_words"] * most_covered
                out.append(None if goes else {"contamination": found, "text": _without_spans(text, found["spans"])})
            yield pa.array(out, _CLEANED_ARROW)

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_covered: float = MOST_COVERED) -> DataFrame:
    """``docs`` without the spans that occur in the benchmark, and without documents that are covered by more than the limit.

    Same columns as ``docs``. Documents without hits are left as they are, null and empty texts among them.
    """
    result = "cleaned"
    while result in map(str.lower, docs.columns):
        result += "_"
    clean = _clean(_shared_automata(docs.sparkSession, benchmark), most_covered)
    left = keep_computed(docs, result, clean(F.col(text_col)))
    new = {"contamination": F.col(f"{result}.contamination"), text_col: F.col(f"{result}.text")}
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


@query(
    "op4_decontamination",
    f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
v AS (SELECT item_id, n, list_slice(w, k, k + n - 1) AS win FROM (
  SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM x JOIN v USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("contamination.spans"))
    items = F.col("contamination.items")
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
