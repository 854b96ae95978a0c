"""Byte-level BPE encoding and decoding by recursive queries of DuckDB inside the tasks.

A text is split into pieces by the tokenizer's pattern. Pieces that are tokens by themselves need no merge. The bytes of
the others are rows (word, position, token); a recursive query joins neighbouring rows with the table of merges and
contracts each word's leftmost pair of least rank, until no word has a pair left. Decoding joins the tokens with the
vocabulary and puts their bytes together by an ordered aggregation.

Spark deals the texts; each worker has a database of its own in memory (vocabulary and merges, some 20 MB), which nothing
else sees, and keeps the ids of pieces it has met.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import query, table

#: Pieces of more bytes than this contract a pair at all its places at once.
LONG_WORD = 64
#: Rows that a query for pieces starts with, and rows that it may hold when it goes round more than once.
WORD_ROWS, STATE_ROWS = 200_000, 4_000_000
#: Tokens decoded at once, characters of text split at once (or one text, if that is longer), pieces a worker keeps.
DECODE_TOKENS, BLOCK_CHARS, CACHE_WORDS = 500_000, 2_000_000, 400_000

_VOCABULARY = "CREATE TABLE vocabulary AS SELECT id, hex(data) AS spelled FROM ranks"

# Every way to put a token together from two.
_MERGES = """
CREATE TABLE merges AS
SELECT a.id AS l, b.id AS r, v.id AS merged
FROM vocabulary v, range(2, strlen(v.spelled), 2) s(n)
JOIN vocabulary a ON a.spelled = substr(v.spelled, 1, s.n)
JOIN vocabulary b ON b.spelled = substr(v.spelled, s.n + 1)
"""

# Tokens that, once made, can be part of a pair of lower rank than their own: their pairs are contracted one by one.
_ALONE = """
CREATE TABLE alone AS
SELECT DISTINCT id FROM (SELECT l AS id FROM merges WHERE merged < l UNION ALL SELECT r FROM merges WHERE merged < r)
"""

# Positions stay gapless, so that neighbours are found by an equality join.
_CONTRACT = f"""
WITH RECURSIVE step(word, pos, token, round) AS (
  SELECT word, pos, token, 0 FROM pieces
  UNION ALL
  SELECT s.word, CASE WHEN s.pos > b.best % {LONG_WORD} THEN s.pos - 1 ELSE s.pos END,
         CASE WHEN s.pos = b.best % {LONG_WORD} THEN b.best // {LONG_WORD} ELSE s.token END, s.round + 1
  FROM step s JOIN (
    SELECT a.word, min(m.merged * {LONG_WORD} + a.pos) AS best
    FROM step a JOIN step c ON c.word = a.word AND c.pos = a.pos + 1 JOIN merges m ON m.l = a.token AND m.r = c.token
    GROUP BY a.word
  ) b ON s.word = b.word
  WHERE s.pos <> b.best % {LONG_WORD} + 1
)
SELECT word, list(token ORDER BY pos) AS ids
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
GROUP BY word
"""

# One word. Its pair of least rank is contracted wherever it stands: of places that overlap the 1st, 3rd, ... This is what
# doing it one by one would come to, as no pair of lower rank can come up meanwhile (but for tokens in ``alone``).
_CONTRACT_LONG = """
WITH RECURSIVE step(pos, token, round) AS (
  SELECT pos, token, 0 FROM pieces
  UNION ALL
  SELECT pos, CASE WHEN site THEN merged ELSE token END, round + 1
  FROM (
    SELECT *, lag(site, 1, false) OVER (ORDER BY pos) AS gone
    FROM (
      SELECT *, CASE WHEN merged IS NULL OR merged <> lowest THEN false
                     WHEN lowest IN (SELECT id FROM alone) THEN nth = 1
                     ELSE (nth - min(nth) OVER (PARTITION BY merged, place - nth)) % 2 = 0 END AS site
      FROM (
        SELECT *, row_number() OVER (PARTITION BY merged ORDER BY pos) AS nth, min(merged) OVER () AS lowest
        FROM (
          SELECT s.*, m.merged
          FROM (SELECT *, lead(token) OVER (ORDER BY pos) AS behind, row_number() OVER (ORDER BY pos) AS place
                FROM step WHERE round < {rounds}) s
          LEFT JOIN merges m ON m.l = s.token AND m.r = s.behind))))
  WHERE lowest IS NOT NULL AND NOT gone
)
SELECT token, round FROM step WHERE round = (SELECT max(round) FROM step) ORDER BY pos
"""

_DECODE = """
SELECT text, string_agg(spelled, '' ORDER BY pos) AS spelled
FROM tokens LEFT JOIN vocabulary USING (id) GROUP BY text ORDER BY text
"""


class ByteBpe:
    """Ids of texts, as the tiktoken library gives them for the file of ranks at ``path``, and back."""

    # The pattern's contractions and classes. White space is Unicode's, as the library's regular
    # expressions have it; the standard library's patterns, which are faster, do for texts of ASCII and the letters
    # from U+00C0 to U+017F.
    _LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ſ]*")
    _LATIN_WORDS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+"
        r"| ?[^\x09-\x0d\x20A-Za-z0-9À-ÖØ-öø-ſ]+"
        r"|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+"
    )

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._any = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                  .replace(r"\S", r"\P{White_Space}"))
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._tokens = {data: np.array([id_], "<u4").tobytes() for data, id_ in ranks.items()}
        self._known: dict[str, bytes] = {}
        self._con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self._con.register("ranks", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "data": pa.array(list(ranks), pa.binary())}))
        for statement in (_VOCABULARY, _MERGES, _ALONE):
            self._con.execute(statement)
        self._con.unregister("ranks")

    def _run(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self._con.register(name, rows)
        try:
            return self._con.sql(sql).to_arrow_table()
        finally:
            self._con.unregister(name)

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded each by itself."""
        return (self._LATIN_WORDS if self._LATIN.fullmatch(text) else self._any).findall(text)

    def _learn(self, words: list[str]) -> None:
        """Find the ids of words that are not known."""
        short, rows = [], 0
        for word in words:
            data = word.encode()
            if data in self._tokens:
                self._known[word] = self._tokens[data]
            elif len(data) > LONG_WORD:
                self._known[word] = self._long(data)
            else:
                short.append((word, data))
                rows += len(data)
                if rows >= WORD_ROWS:
                    self._short(short)
                    short, rows = [], 0
        if short:
            self._short(short)

    def _short(self, words: list[tuple[str, bytes]]) -> None:
        sizes = np.array([len(data) for _, data in words], np.int32)
        rows = pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": np.arange(sizes.sum(), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes),
            "token": self._byte[np.frombuffer(b"".join(data for _, data in words), np.uint8)],
        })
        found = self._run(_CONTRACT, "pieces", rows)
        ids = found["ids"].combine_chunks()
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy().astype("<u4")
        for word, start, end in zip(found["word"].to_pylist(), ends, ends[1:]):
            self._known[words[word][0]] = flat[start:end].tobytes()

    def _long(self, data: bytes) -> bytes:
        tokens = self._byte[np.frombuffer(data, np.uint8)]
        while True:
            # A query keeps the rows of all its rounds: it stops in between, and goes on from the last.
            rounds = max(1, STATE_ROWS // len(tokens))
            rows = pa.table({"pos": np.arange(len(tokens), dtype=np.int32), "token": tokens})
            found = self._run(_CONTRACT_LONG.format(rounds=rounds), "pieces", rows)
            tokens = found["token"].to_numpy().astype(np.int32)
            if found["round"][0].as_py() < rounds:
                return tokens.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        split = [self.words(t) for t in texts]
        new = dict.fromkeys(w for words in split for w in words if w not in known)
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids."""
        out = [[] for _ in ids]
        for places, run in _runs(ids):
            sizes = np.array([len(part) // 4 for part in run])
            rows = pa.table({
                "text": np.repeat(np.array(places, np.int64), sizes),
                "pos": np.arange(sizes.sum(), dtype=np.int32),
                "id": np.frombuffer(b"".join(run), "<u4").astype(np.int32),
            })
            found = self._run(_DECODE, "tokens", rows)
            for text, spelled in zip(found["text"].to_pylist(), found["spelled"].to_pylist()):
                out[text].append(bytes.fromhex(spelled or ""))
        return [b"".join(parts) for parts in out]


def _runs(ids: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of at most DECODE_TOKENS tokens: (whose they are, their ids); a longer text is in several."""
    places, run, left = [], [], 4 * DECODE_TOKENS
    for place, data in enumerate(ids):
        at = 0
        while at < len(data):
            part = data[at:at + left]
            places.append(place)
            run.append(part)
            at, left = at + len(part), left - len(part)
            if not left:
                yield places, run
                places, run, left = [], [], 4 * DECODE_TOKENS
    if run:
        yield places, run


_coders: dict[tuple[str, str], ByteBpe] = {}


def _coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def default_ranks() -> tuple[str, str]:
    """The file of ranks and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _blocks(sizes: list[int], most: int) -> Iterator[slice]:
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(first, k)
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _kept(docs: DataFrame, id_col: str, column: str, name: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(column).alias(name))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None, decoded: bool = False
) -> DataFrame:
    """(id, n_tokens, ids) of every row; ids are 4 bytes each, little-endian. With ``decoded`` also the bytes they stand for.

    A null text is encoded as an empty one: no ids. Rows come out one for one, whatever their ids are; null ids and
    repeated rows are rows like others, an empty table gives none. Other columns are not read. A task holds a block of
    texts, or one text if that is longer, and some 30 bytes for each byte of its longest piece.
    """
    path, pattern = ranks or default_ranks()
    rows, id_type = _kept(docs, id_col, text_col, "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for part in _blocks([len(t) for t in texts], BLOCK_CHARS):
                ids = coder.encode(texts[part])
                out = {
                    "id": batch.column(0).slice(part.start, part.stop - part.start),
                    "n_tokens": pa.array([len(data) // 4 for data in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                }
                if decoded:
                    out["data"] = pa.array(coder.decode(ids), pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(encoded, f"id {id_type}, n_tokens long, ids binary" + (", data binary" if decoded else ""))


def decode(
    tokens: DataFrame, id_col: str = "id", ids_col: str = "ids", ranks: tuple[str, str] | None = None
) -> DataFrame:
    """(id, data): the bytes that each row's ids stand for. Null ids are none; ids that are no tokens stand for nothing."""
    path, pattern = ranks or default_ranks()
    rows, id_type = _kept(tokens, id_col, ids_col, "ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            ids = batch.column(1).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(ids), pa.binary())], ["id", "data"])

    return rows.mapInArrow(decoded, f"id {id_type}, data binary")


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), decoded=True).select(
        F.col("id").alias("doc_id"), "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"),
    )
