"""HTML as columns.

The only Python here turns one HTML string into a flat list of nodes in document order
(``html_nodes``) or into its plain text (``html_to_text``), a slice of an Arrow batch at a time: a worker
has the batch and the nodes of some pages in memory, however many pages the batch has.
Every rule about those nodes (which anchor is a listing, what is its card, where is the
company) is a Column expression further down.

A node knows its subtree as the index range ``idx .. last``, which is a slice of the list, and
its parent; so rules look at the nodes of one card, not at the page, again and again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.text import WHITESPACE, strip

_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Text below these is not page text.
_NO_TEXT = frozenset(["script", "style", "template", "rt", "rp"])
_ATTRIBUTES = ["href", "class", "title", "datetime", "data-testid"]

NODE = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("testid", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
NODES = T.ArrayType(NODE)
_NODE_ARROW = pa.struct([(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in NODE])
_TAG = 4
#: Pages that are parsed before their result is sent on: of so many bytes and rows at most, or a single one.
_SLICE_BYTES, _SLICE_ROWS = 1 << 20, 1000


class _Flattener(HTMLParser):
    """Collects elements and text nodes in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[list] = []
        # The document itself is node 0, so everything has an ancestor.
        self.open.append(self._add("[document]", [None] * len(_ATTRIBUTES), None))
        self.muted = 0
        self.run_of_text: list | None = None

    def _add(self, tag: str, attributes: list, text: str | None) -> list:
        at, parent = len(self.nodes), self.open[-1][0] if self.open else -1
        node = [at, at, parent, len(self.open), tag, *attributes, text]
        self.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        self.run_of_text = None
        given = {name: value or "" for name, value in attrs}
        node = self._add(tag, [given.get(a) for a in _ATTRIBUTES], None)
        if tag not in _VOID:
            self.open.append(node)
            self.muted += tag in _NO_TEXT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.run_of_text = None
        if any(node[_TAG] == tag for node in self.open):
            while self._close()[_TAG] != tag:
                pass

    def handle_data(self, data):
        if self.muted:
            return
        if self.run_of_text is None:
            self.run_of_text = self._add("#text", [None] * len(_ATTRIBUTES), "")
        self.run_of_text[-1] += data

    def _break_text(self, _):
        self.run_of_text = None

    handle_comment = handle_decl = handle_pi = unknown_decl = _break_text

    def _close(self) -> list:
        node = self.open.pop()
        node[1] = len(self.nodes) - 1
        self.muted -= node[_TAG] in _NO_TEXT
        return node

    def run(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        while self.open:
            self._close()
        return self.nodes


def _lines(text: str) -> list[str]:
    return [line for line in (raw.strip(WHITESPACE) for raw in text.splitlines()) if line]


def _plain(html: str | None) -> str:
    if not html:
        return ""
    if "<" in html or "&" in html:
        html = "\n".join(n[-1] for n in _Flattener().run(html) if n[_TAG] == "#text")
    return "\n".join(_lines(html))


def _slices(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < len(batch):
            stop = int(np.searchsorted(ends, before + _SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + _SLICE_ROWS)
            yield batch.slice(start, stop - start).to_pylist()
            start, before = stop, ends[stop - 1]


def _node_lists(pages: list[str | None]) -> pa.Array:
    """The nodes of each page as Arrow columns; none for an empty page or NULL."""
    found = [_Flattener().run(h) if h else [] for h in pages]
    columns = zip(*[node for nodes in found for node in nodes]) if any(found) else [()] * len(_NODE_ARROW)
    nodes = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_ARROW)], fields=list(_NODE_ARROW))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), nodes)


@F.arrow_udf(NODES)
def html_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in _slices(batches):
        yield _node_lists(pages)


@F.arrow_udf(T.StringType())
def html_to_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text nodes on lines of their own, stripped, blank lines dropped; '' for nothing."""
    for pages in _slices(batches):
        yield pa.array(map(_plain, pages), pa.string())


@F.pandas_udf(T.StringType())
def resolve_entities(text: pd.Series) -> pd.Series:
    """``&amp;`` and friends to characters; '' for NULL."""
    return text.map(lambda t: unescape(t) if t else "")


# ------------------------------------------------------------------ node expressions
def inside(x: Column, outer: Column) -> Column:
    return (x["idx"] >= outer["idx"]) & (x["idx"] <= outer["last"])


def subtree(nodes: Column, scope: Column) -> Column:
    """The node and everything below it; NULL for a NULL node."""
    return F.slice(nodes, scope["idx"] + 1, scope["last"] - scope["idx"] + 1)


def select(nodes: Column, scope: Column, wanted: Callable[[Column], Column]) -> Column:
    """All nodes below ``scope`` that are ``wanted``, in document order."""
    return F.filter(F.slice(nodes, scope["idx"] + 2, scope["last"] - scope["idx"]), wanted)


def has_class(x: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(x["class"], F.lit("")), r"\s+"), name)


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def find(nodes: Column, scope: Column, wanted: Callable[[Column], Column]) -> Column:
    """First node below ``scope`` that is ``wanted``, else NULL."""
    return first(select(nodes, scope, wanted))


def text_pieces(nodes: Column, scope: Column) -> Column:
    """Stripped, non-empty text nodes of the subtree; NULL scope gives NULL."""
    texts = F.filter(subtree(nodes, scope), lambda x: x["tag"] == "#text")
    return F.filter(F.transform(texts, lambda x: strip(x["text"])), lambda s: s != "")


def node_text(nodes: Column, scope: Column, separator: str = " ") -> Column:
    return F.array_join(text_pieces(nodes, scope), separator)


def ancestors(nodes: Column, node: Column) -> Column:
    """Proper ancestors, outermost first, found by following the parents."""
    chain = F.aggregate(
        F.when(node["depth"] > 0, F.sequence(F.lit(1), node["depth"])),
        F.array(node),
        lambda chain, _: F.concat(F.array(F.element_at(nodes, chain[0]["parent"] + 1)), chain),
    )
    return F.slice(chain, F.lit(1), F.size(chain) - 1)
