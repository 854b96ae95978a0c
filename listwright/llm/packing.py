"""Packing of token sequences by patterns.

Documents are tokenised and cut into pieces of at most the sequence length. The packing is planned on the histogram of
piece lengths alone, which has at most as many entries as a sequence has tokens, however large the corpus is:

1. all patterns of one to three lengths that fill a sequence are enumerated;
2. non-negative least squares fits their repeat counts to the histogram;
3. the counts are rounded, as far as the histogram has pieces for them;
4. the pieces left over are packed best-fit, longest first, on the histogram as well.

The pieces of a length are numbered, and the plan says for each range of numbers where it goes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import query, table, written

SEQUENCE = 2048
#: The id that ends each document.
END_ID = 0
#: Steps of the least-squares fit.
FIT_STEPS = 300
#: How much of the fitted repeat counts is followed.
SHARES = (1.0, 0.5, 0.25, 0.1)
#: Pieces of a length are numbered in groups of about so many.
GROUP_ROWS = 256
#: Words whose ids a worker keeps; then it starts over.
CACHE_WORDS = 200_000


class WordTokenizer:
    """Ids of texts as the ``word_bpe_49k`` tokenizer gives them, with its answers for words kept.

    The tokenizer lower-cases, drops white space, splits into words by a pattern and encodes each by itself, so a text's
    ids are its words' ids in a row. Only words that are not known yet go through the tokenizer's model.
    """

    # The tokenizer's word pattern (its white space is Unicode's), and what it takes as special tokens.
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
    _SPECIAL = ("<|startoftext|>", "<|endoftext|>")

    # The same for texts of ASCII and of the letters up to U+017F, which composing leaves as they are and whose lower
    # case is among them (but for U+0130): the standard library's patterns are faster.
    _LATIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
    _LATIN_WORDS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]"
        r"|[^\x09-\x0d\x20a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+"
    )

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._any = regex.compile(self._PATTERN)
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # The model knows bytes by stand-in characters, printable ASCII by itself.
        spelled = word if word.isascii() and word.isprintable() else self._bytes.pre_tokenize_str(word)[0][0]
        return np.array([t.id for t in self._tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def forget(self) -> None:
        self._known.clear()

    def encode(self, text: str) -> bytes:
        """The ids, four bytes each, little-endian."""
        if any(s in text for s in self._SPECIAL):
            return self._whole(text)
        if self._LATIN.fullmatch(text):
            words = self._LATIN_WORDS.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # str.lower() looks at a sigma's place in its word, the tokenizer does not.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            words = self._any.findall(text)
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for word, data in zip(words, found):
                if data is None and word not in known:
                    known[word] = self._word(word)
            found = map(known.__getitem__, words)
        return b"".join(found)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>"
_PIECE_ARROW = pa.list_(pa.struct([
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
]))


def pieces_of(text: Column, path: str | None = None, length: int = SEQUENCE, keep_ids: bool = False) -> Column:
    """ARRAY<STRUCT<start, length, ids_crc32, ids>>: a text's pieces; ids are null unless asked for.

    Each text ends with END_ID; a null text is empty and has that id alone.
    """

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(path or default_tokenizer())
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for text in batch:
                data = tokenizer.encode(text.as_py() or "") + end
                pieces = []
                for start in range(0, len(data) // 4, length):
                    part = data[4 * start:4 * (start + length)]
                    ids = np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None
                    pieces.append({"start": start, "length": len(part) // 4, "ids_crc32": zlib.crc32(part), "ids": ids})
                out.append(pieces)
            yield pa.array(out, _PIECE_ARROW)
        tokenizer.forget()  # the worker goes on to other tasks

    cut.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(cut, _PIECE)(text)


@dataclass(frozen=True)
class Group:
    """``repeats`` sequences that hold the same lengths: runs of (length, times)."""

    runs: tuple[tuple[int, int], ...]
    repeats: int


def enumerate_patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All patterns of one to three of the present lengths that sum to ``size``: rows of three, ascending, 0 for none."""
    have = np.zeros(size + 1, bool)
    have[present] = True
    have[0] = True  # an absent member
    lengths = np.flatnonzero(have)
    rows = []
    for a in lengths[lengths <= size // 3]:
        b = lengths[(lengths >= a) & (lengths <= (size - a) // 2)]
        c = size - a - b
        rows.append(np.stack([np.full(len(b), a), b, c], axis=1)[have[c]])
    return np.concatenate(rows).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts >= 0 whose pieces are nearest to the histogram, by accelerated projected gradient."""
    size = len(histogram)
    if not len(patterns):
        return np.zeros(0)
    flat = patterns.ravel()
    used = lambda x: np.bincount(flat, np.repeat(x, 3), size)
    target = histogram.astype(float)

    def gathered(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0.0  # absent members weigh nothing
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = gathered(used(v))
        v /= np.linalg.norm(v)
    step = 1.0 / (1.05 * float(v @ gathered(used(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * gathered(used(y) - target))
        t_new = (1.0 + (1.0 + 4.0 * t * t) ** 0.5) / 2.0
        y = new + (t - 1.0) / t_new * (new - x)
        x, t = new, t_new
    return x


def round_repeats(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> list[Group]:
    """Whole repeat counts, never more than there are pieces for; takes what it uses off the histogram.

    The counts are rounded along their running sum, which keeps the totals of neighbouring patterns: a pattern of far
    less than one repeat gets one now and then, instead of none ever.
    """
    sums = np.floor(np.cumsum(repeats) + 0.5)
    whole = np.diff(np.concatenate([[0.0], sums])).astype(np.int64)
    groups = []
    for k in np.flatnonzero(whole):
        lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(int(whole[k]), int((histogram[lengths] // times).min()))
        if n > 0:
            histogram[lengths] -= n * times
            groups.append(Group(tuple((int(a), int(b)) for a, b in zip(lengths[::-1], times[::-1])), n))
    return groups


def best_fit(histogram: np.ndarray, size: int) -> list[Group]:
    """All pieces of the histogram, longest first, each into the sequence with the least room that takes it.

    Sequences that hold the same lengths are handled together, so the work depends on the lengths, not on the pieces.
    """
    open_: dict[int, list[Group]] = {}
    rooms = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        n = int(histogram[length])
        while n:
            ahead = rooms[length:]
            at = int(ahead.argmax())
            if ahead[at]:
                room = length + at
                group = open_[room].pop()
                rooms[room] = bool(open_[room])
            else:
                room, group = size, Group((), n)
            each = room // length
            if n < each:
                each, packs = n, 1
            else:
                packs = min(group.repeats, n // each)
            if packs < group.repeats and group.runs:
                open_.setdefault(room, []).append(Group(group.runs, group.repeats - packs))
                rooms[room] = True
            left = room - each * length
            open_.setdefault(left, []).append(Group((*group.runs, (length, each)), packs))
            rooms[left] = True
            n -= packs * each
    return [g for groups in open_.values() for g in groups]


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[Group]:
    """The packing of a histogram of piece lengths (index: length, 0 to ``size``).

    Where the patterns cannot fit the histogram, following them to the end can use up the pieces that the rest would need.
    So they are followed for each of SHARES, and the plan of the fewest sequences is taken.
    """
    patterns = enumerate_patterns(np.flatnonzero(histogram), size)
    repeats = fit_repeats(patterns, histogram)
    plans = []
    for share in SHARES:
        left = histogram.astype(np.int64)
        groups = round_repeats(patterns, repeats * share, left)
        plans.append(groups + best_fit(left, size))
    return min(plans, key=lambda groups: sum(g.repeats for g in groups))


class Slots:
    """The plan as ranges: pieces ``first`` to the next range's of a length fill sequences from ``sequence`` on."""

    def __init__(self, groups: list[Group], size: int):
        taken = np.zeros(size + 1, np.int64)
        rows, sequence = [], 0
        for group in groups:
            offset = 0
            for length, times in group.runs:
                rows.append((length, taken[length], times, sequence, offset))
                taken[length] += times * group.repeats
                offset += length * times
            sequence += group.repeats
        rows.sort()
        self.length, self.first, self.times, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.sequences = sequence
        # A key that grows with length and number: numbers of a length are below the total.
        self.step = int(taken.max()) + 1
        self.key = self.length * self.step + self.first

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and numbers."""
        at = np.searchsorted(self.key, length * self.step + number, side="right") - 1
        j, times = number - self.first[at], self.times[at]
        return self.sequence[at] + j // times, self.offset[at] + j % times * length


def pack(
    docs: DataFrame, path: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset): each piece of each row of ``docs``, packed.

    Null and empty texts are one piece of one id. Repeated rows, and rows with a null id, are pieces of their own each.
    An empty table has no sequences. Pieces of the same length are interchangeable: which goes where is decided by a hash
    of id and piece. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = written(
        docs.select(F.col(id_col).alias("id"), F.posexplode(pieces_of(F.col(text_col), path, size, keep_ids)).alias("piece", "p"))
        .select("id", "piece", "p.start", "p.length", "p.ids_crc32", *(["p.ids"] if keep_ids else [])),
        "pieces",
    )
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in lengths.collect():  # one row for each length, ``size`` at most
        histogram[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(Slots(plan(histogram, size), size))

    # Number the pieces of each length; frequent lengths in many groups, so that none is a single task's.
    spread = F.broadcast(lengths.select("length", F.ceil(F.col("n") / GROUP_ROWS).alias("groups")))
    rows = pieces.join(spread, "length").withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    groups = rows.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")
    groups = groups.select("length", "group", before.alias("before"))
    in_group = Window.partitionBy("length", "group").orderBy("id", "piece", "ids_crc32")
    rows = rows.join(groups, ["length", "group"]).withColumn("number", F.col("before") + F.row_number().over(in_group) - 1)

    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        sequence, offset = slots.value.place(length.to_numpy(), number.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], fields=list(kind))

    return rows.withColumn("at", place("length", "number")).select(
        "id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "at.sequence_id", "at.offset"
    )


@query("op1_pattern_packing")
def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
