"""Language identification: words first, shorter and shorter character n-grams for words that are not known.

The model has the log frequency, per language, of every word and every character n-gram of the labelled texts, for every
label. While it is small (MODEL_BYTES) it is broadcast whole. A larger one stays in written tables: the most frequent
words and n-grams, as many as the bytes allow, are broadcast, and what else the texts have is looked up by joins, each word
and n-gram once. Both ways give the same answers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import discard, join_groups, query, release_shuffles, table, written
from listwright.llm.near_dedup import in_filter, key_filter

LONGEST_GRAM = 5
#: Words take so many bytes of what is broadcast at most, and n-grams as many; a unit takes UNIT_BYTES and four for each
#: language.
MODEL_BYTES, UNIT_BYTES = 16 << 20, 160
#: Added to each count.
SMOOTHING = 0.5
#: A text of more words than this is as sure as one of this many with the same average.
SURE_WORDS = 20
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_COUNTER_SIZE = 200_000
_FACTOR = 0x9E3779B97F4A7C15
#: Texts that are answered together.
_TOGETHER = 64
#: Unseen words that a worker remembers.
_CACHE_SIZE = 300_000
#: The texts are answered in so many rounds, so that shuffle files are there for a part of the words at a time.
_ROUNDS = 2


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _flush(counters: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """A batch for each language; the counters are empty afterwards."""
    while counters:
        lang, counts = counters.popitem()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
            names=["lang", "unit", "n"],
        )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n); a word comes again when the counter was full in between."""
    counters: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            counters.setdefault(lang.as_py(), Counter()).update(_words(text.as_py()))
            if sum(map(len, counters.values())) > _COUNTER_SIZE:
                yield from _flush(counters)
    yield from _flush(counters)


def _grams(word: str) -> Iterator[str]:
    framed = f"^{word}$"
    for n in range(1, LONGEST_GRAM + 1):
        for i in range(len(framed) - n + 1):
            yield framed[i:i + n]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) to (lang, gram, n)."""
    counters: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts = counters.setdefault(lang, Counter())
            for gram in _grams(word):
                counts[gram] += n
            if len(counts) * len(counters) > _COUNTER_SIZE:
                yield from _flush(counters)
    yield from _flush(counters)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters that end at each place; the first n - 1 places have no meaning."""
    out = chars.copy()
    for k in range(1, n):
        out[k:] = out[k:] + chars[:len(chars) - k] * np.uint64(pow(_FACTOR, k, 1 << 64))
    out ^= out >> np.uint64(32)
    return out * np.uint64(_FACTOR)


@dataclass
class Rest:
    """Written tables of all units, (unit, n, counts MAP<lang, n>), and the log frequencies, by language, of a word and of
    n-grams of 1 to LONGEST_GRAM characters without a count."""

    words: DataFrame
    grams: DataFrame
    base: np.ndarray


@dataclass
class LanguageModel:
    """Log frequencies by unit, one row of ``table`` for each; words and n-grams (framed with ^ and $) apart.

    If it has a ``rest`` it is not whole: it has the frequent units alone, and for each how far its log frequency is above
    that of a unit without a count.
    """

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    rest: Rest | None = None

    def __getstate__(self):
        return {**self.__dict__, "rest": None}

    def __post_init__(self):
        #: For each n, the n-grams' hashes, ascending, and their rows.
        self._hashed = []
        for n in range(1, LONGEST_GRAM + 1):
            own = [g for g in self.grams if len(g) == n]
            hashes = _gram_hashes(_code_points("".join(own)), n)[n - 1::n] if own else np.zeros(0, np.uint64)
            order = np.argsort(hashes)
            self._hashed.append((hashes[order], np.array([self.grams[g] for g in own], np.int64)[order]))
        self._forget()

    def _forget(self) -> None:
        """Start anew with the rows of the known words alone."""
        self._rows = self.table[:len(self.words)]
        self._letters = np.zeros(len(self.words), np.int64)
        self._letters[list(self.words.values())] = list(map(len, self.words))
        self._size, self._place = len(self.words), dict(self.words)

    def _learn(self, words: list[str]) -> None:
        """Rows for words that are not known: the mean over their characters of the longest known n-gram that ends
        there; characters without one say nothing, and words without a known character neither."""
        sizes = np.array([len(w) + 2 for w in words])
        chars = _code_points("".join([f"^{w}$" for w in words]))
        word = np.repeat(np.arange(len(words)), sizes)
        depth = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = np.full(len(chars), -1, np.int64)
        for n in range(LONGEST_GRAM, 0, -1):
            hashes, places = self._hashed[n - 1]
            open_ = np.flatnonzero((found < 0) & (depth >= max(n - 1, 1)))
            if not len(hashes) or not len(open_):
                continue
            own = _gram_hashes(chars, n)[open_]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[at] == own
            found[open_[hit]] = places[at[hit]]
        hits = found >= 0
        letters = np.bincount(word[hits & (depth < np.repeat(sizes, sizes) - 1)], minlength=len(words))
        hits &= letters[word] > 0
        word, found = word[hits], found[hits]
        counts = np.maximum(np.bincount(word, minlength=len(words)), 1)
        rows = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            rows[:, k] = np.bincount(word, self.table[found, k], len(words)) / counts
        if self._size + len(words) > len(self._rows):
            self._rows = np.concatenate([self._rows[:self._size], np.zeros_like(rows), self._rows[:self._size]])
        self._rows[self._size:self._size + len(words)] = rows
        self._letters = np.concatenate([self._letters[:self._size], letters])
        self._place.update(zip(words, range(self._size, self._size + len(words))))
        self._size += len(words)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int, int, int]]:
        if self._size > len(self.words) + _CACHE_SIZE:
            self._forget()
        split = [_words(text) if text and self.languages else [] for text in texts]
        place = self._place
        missing = {w: None for words in split for w in words if w not in place}
        if missing:
            self._learn(list(missing))
        return [self._answer(words) for words in split]

    def _answer(self, words: list[str]) -> tuple[str, float, int, int, int]:
        if not _lettered(words):
            return UNKNOWN, 0.0, 0, 0, 0
        places = np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))
        total = self._rows[places].sum(axis=0, dtype=np.float64)
        return *self.surest(total, len(words)), len(words), sum(map(len, words)), int(self._letters[places].sum())

    def surest(self, total: np.ndarray, n_words: int) -> tuple[str, float]:
        """The language and its share for a text's sum of log frequencies."""
        logits = np.round(total / n_words * min(n_words, SURE_WORDS), 9)  # sums may come in any order
        shares = np.exp(logits - logits.max())
        shares /= shares.sum()
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def _lettered(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def _most(units: DataFrame, most: int) -> DataFrame:
    """The units that come most often, ``most`` of them or fewer: classes of about the same n go in or stay out whole."""
    size = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in units.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():
        left -= row["n"]
        if left < 0:
            break
        least = row["size"]
    return units.filter(size >= F.lit(least)) if least is not None else units.limit(0)


def fit(texts: DataFrame) -> LanguageModel:
    """Learn from (lang, text) rows without nulls. Without rows the model knows no language and answers ``und``."""
    words = written(
        texts.select("lang", "text").mapInArrow(_count_words, "lang string, unit string, n long")
        .groupBy("lang", "unit").agg(F.sum("n").alias("n")),
        "language-words",
    )
    totals = dict(words.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    grams = words.mapInArrow(_count_grams, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    grams = written(grams, "language-grams")
    order = F.length("unit")
    gram_totals = {(r["lang"], r["k"]): r["n"] for r in grams.groupBy("lang", order.alias("k")).agg(F.sum("n").alias("n")).collect()}

    def by_unit(counts: DataFrame, label: str) -> DataFrame:
        pairs = F.map_from_entries(F.collect_list(F.struct("lang", "n")))  # as many as there are languages
        return written(counts.groupBy("unit").agg(F.sum("n").alias("n"), pairs.alias("counts")), label)

    word_units, gram_units = by_unit(words, "language-word-units"), by_unit(grams, "language-gram-units")
    discard(words, grams)
    release_shuffles(texts.sparkSession)
    n_words = word_units.count()
    per_order = dict(gram_units.groupBy(order.alias("k")).count().collect())
    sizes = [np.array([totals[l] for l in languages], float) + SMOOTHING * n_words] + [
        np.array([gram_totals.get((l, k), 0) for l in languages], float) + SMOOTHING * max(per_order.get(k, 0), 1)
        for k in range(1, LONGEST_GRAM + 1)
    ]
    base = np.log(SMOOTHING / np.array(sizes))
    at = {l: k for k, l in enumerate(languages)}
    most = MODEL_BYTES // (UNIT_BYTES + 4 * len(languages))

    def rows_of(units: DataFrame) -> tuple[list[str], np.ndarray]:
        """Units, and how far each is above one without a count."""
        rows = sorted(units.select("unit", "counts").collect())
        above = np.zeros((len(rows), len(languages)), np.float64)
        for k, (_, counts) in enumerate(rows):
            for lang, n in counts.items():
                above[k, at[lang]] = np.log((n + SMOOTHING) / SMOOTHING)
        return [unit for unit, _ in rows], above

    if n_words > most or sum(per_order.values()) > most:
        known, above = rows_of(_most(word_units, most))
        parts, gram_rows = rows_of(_most(gram_units, most))
        return LanguageModel(
            languages, dict(zip(known, range(len(known)))), {g: k + len(known) for k, g in enumerate(parts)},
            np.concatenate([above, gram_rows]).astype(np.float32), Rest(word_units, gram_units, base),
        )
    known, above = rows_of(word_units)
    parts, gram_rows = rows_of(gram_units)
    matrix = np.concatenate([above + base[0], gram_rows + base[[len(g) for g in parts]]]) if parts else above + base[0]
    discard(word_units, gram_units)
    return LanguageModel(
        languages, dict(zip(known, range(len(known)))), {g: k + len(known) for k, g in enumerate(parts)}, matrix.astype(np.float32)
    )


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of all labelled texts of ``docs`` that are not held out."""
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return fit(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))


_ANSWER = "lang string, score double, n_words long, n_letters long, n_known long"
_ANSWER_ARROW = pa.struct([
    ("lang", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_letters", pa.int64()), ("n_known", pa.int64()),
])


def _as_answers(answers: list[tuple]) -> pa.Array:
    return pa.array([dict(zip(_ANSWER_ARROW.names, a)) for a in answers], _ANSWER_ARROW)


def predicted(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """STRUCT<lang, score, n_words, n_letters, n_known> of each text, over its whole length, by a whole model.

    ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned. Ties go to the first
    language by name. n_letters are those of the words, n_known those of seen words and those of other words at which a
    known n-gram ends.
    """
    if model.rest is not None:
        raise ValueError("the model is too large to broadcast whole; use identified()")
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_ANSWER)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            answers = []
            for start in range(0, len(batch), _TOGETHER):
                answers += known.predict(batch.slice(start, _TOGETHER).to_pylist())
            yield _as_answers(answers)
        known._forget()  # the worker goes on to other tasks

    return predict(text)


_PART = "n_words long, n_letters long, n_frequent long, n_known long, langs array<int>, above array<double>, words array<string>, times array<int>"


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def _frequent_part(spark: SparkSession, model: LanguageModel):
    """What the broadcast words say of a text, and its other words, each with how often it comes. n_known are the letters of
    the broadcast words."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_PART)
    def part(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        place = known.words
        for batch in batches:
            sizes, totals, n_rest, rest_words, rest_times = [], [], [], [], []
            for text in batch:
                words = _words(text.as_py() or "")
                if not _lettered(words):
                    words = []
                places = list(map(place.get, words))
                rest = Counter([w for w, k in zip(words, places) if k is None])
                places = [k for k in places if k is not None]
                totals.append(known.table[places].sum(axis=0, dtype=np.float64))
                letters = sum(map(len, words))
                sizes.append((len(words), letters, len(places), letters - sum(len(w) * n for w, n in rest.items())))
                n_rest.append(len(rest))
                rest_words += rest
                rest_times += rest.values()
            totals = np.array(totals).reshape(len(batch), len(known.languages))
            text, lang = np.nonzero(totals)
            n_langs = np.bincount(text, minlength=len(batch))
            yield pa.StructArray.from_arrays(
                [pa.array(c) for c in np.array(sizes, np.int64).reshape(-1, 4).T]
                + [_lists(n_langs, pa.array(lang, pa.int32())), _lists(n_langs, pa.array(totals[text, lang])),
                   _lists(n_rest, pa.array(rest_words, pa.string())), _lists(n_rest, pa.array(rest_times, pa.int32()))],
                ["n_words", "n_letters", "n_frequent", "n_known", "langs", "above", "words", "times"],
            )

    return part


_UNSEEN = ("word string, letters long, orders array<long>, langs array<string>, above array<double>, "
           "open array<struct<place:int,letter:boolean,unit:string>>")
_UNSEEN_ARROW = pa.schema([
    ("word", pa.string()), ("letters", pa.int64()), ("orders", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())),
    ("above", pa.list_(pa.float64())),
    ("open", pa.list_(pa.struct([("place", pa.int32()), ("letter", pa.bool_()), ("unit", pa.string())]))),
])


def _by_broadcast_grams(model, bits):
    """(word) to _UNSEEN: what the broadcast n-grams say of the places whose longest one is surely among them, and the
    n-grams that may be the longest of the other places. The filter has the bits of all n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, filter_ = model.value, bits.value
        grams = known.grams
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                words = batch.column(0).slice(start, 1000).to_pylist()
                best: list[dict[int, str]] = [{} for _ in words]
                longer = []
                for i, word in enumerate(words):
                    framed = f"^{word}$"
                    for end in range(1, len(framed)):
                        for k in range(min(LONGEST_GRAM, end + 1), 0, -1):
                            unit = framed[end - k + 1:end + 1]
                            if unit in grams:
                                best[i][end] = unit
                                break
                            longer.append((i, end, unit))
                keys = np.array([xxhash.xxh64_intdigest(unit.encode(), 42) for _, _, unit in longer], np.uint64).view(np.int64)
                open_: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
                for at in np.flatnonzero(in_filter(filter_, keys)):
                    i, end, unit = longer[at]
                    open_[i][end].append(unit)
                out = []
                for i, word in enumerate(words):
                    last, wide = len(word) + 1, open_.get(i, {})
                    closed = {end: unit for end, unit in best[i].items() if end not in wide}
                    total = known.table[[grams[u] for u in closed.values()]].sum(axis=0, dtype=np.float64)
                    hit = np.flatnonzero(total)
                    out.append({
                        "word": word, "letters": sum(end < last for end in closed),
                        "orders": np.bincount(np.array([len(u) for u in closed.values()], np.int64), minlength=LONGEST_GRAM + 1).tolist(),
                        "langs": [known.languages[k] for k in hit], "above": total[hit].tolist(),
                        "open": [
                            {"place": end, "letter": end < last, "unit": u}
                            for end, units in wide.items() for u in units + ([best[i][end]] if end in best[i] else [])
                        ],
                    })
                yield pa.RecordBatch.from_pylist(out, _UNSEEN_ARROW)

    return run


def _looked_up(asked: DataFrame, model: LanguageModel) -> DataFrame:
    """(word, size, letters, orders, langs, above) of the asked words (word, size): the known letters, how many of the n-grams
    that say something are of each length (null: the word itself is known), and what is above the base by the number of the
    language. Words of which no letter is known are not there."""
    def above(n: Column) -> Column:
        return F.log((n + SMOOTHING) / SMOOTHING)

    rest, context = model.rest, asked.sparkSession.sparkContext
    found = written(asked.join(rest.words.select(F.col("unit").alias("word"), "counts"), "word", "left"), "asked-words")
    seen = found.filter(F.col("counts").isNotNull()).select(
        "word", "size", F.length("word").alias("letters"), F.lit(None).cast("array<int>").alias("orders"),
        F.map_keys("counts").alias("langs"), F.transform(F.map_values("counts"), above).alias("above"),
    )
    unseen = found.filter(F.col("counts").isNull()).select("word", "size")
    release_shuffles(asked.sparkSession)
    bits = context.broadcast(key_filter(rest.grams.select(F.xxhash64("unit").alias("key"))))
    split = written(unseen.select("word").mapInArrow(_by_broadcast_grams(context.broadcast(model), bits), _UNSEEN), "unseen-words")
    places = written(split.select("word", F.explode("open").alias("o")).select("word", "o.*"), "unseen-places")
    wanted = places.groupBy("unit").agg(F.count(F.lit(1)).alias("n_places")).join(rest.grams.select("unit", "counts"), "unit")
    wanted = written(wanted, "wanted-grams")
    n_places = places.count()
    hits = join_groups(places, wanted.select("unit", "n_places"), "unit", "n_places", n_places)
    hits = hits.groupBy("word", "place").agg(F.max(F.struct(F.length("unit"), "unit", "letter")).alias("hit"))
    hits = written(hits.select("word", "hit.unit", "hit.letter"), "unseen-hits")  # the longest n-gram of each place
    orders = hits.groupBy("word").agg(
        F.count_if("letter").alias("more_letters"),
        F.array(F.lit(0).cast("long"), *[F.count_if(F.length("unit") == k) for k in range(1, LONGEST_GRAM + 1)]).alias("more_orders"),
    )
    said = join_groups(hits.select("word", "unit"), wanted, "unit", "n_places", n_places)
    said = said.select("word", F.explode("counts").alias("lang", "n")).groupBy("word", "lang").agg(F.sum(above(F.col("n"))).alias("above"))
    said = said.groupBy("word").agg(F.collect_list(F.struct("lang", "above")).alias("more"))
    both = split.drop("open").join(orders, "word", "left").join(said, "word", "left")
    both = both.withColumn("letters", F.col("letters") + F.coalesce("more_letters", F.lit(0))).filter("letters > 0")
    none = F.array([F.lit(0).cast("long")] * (LONGEST_GRAM + 1))
    both = both.withColumn("orders", F.zip_with("orders", F.coalesce("more_orders", none), lambda a, b: a + b))
    both = both.withColumn("m", F.aggregate("orders", F.lit(0).cast("long"), lambda a, b: a + b))
    more = F.coalesce("more", F.array().cast("array<struct<lang:string,above:double>>"))
    sums = F.concat("above", F.transform(more, lambda e: e["above"]))
    by_grams = both.select(
        "word", F.col("letters").cast("int").alias("letters"), F.col("orders").cast("array<int>").alias("orders"),
        F.concat("langs", F.transform(more, lambda e: e["lang"])).alias("langs"), F.transform(sums, lambda a: a / F.col("m")).alias("above"),
    )
    by_grams = unseen.join(by_grams, "word").select("word", "size", "letters", "orders", "langs", "above")
    place = F.create_map(*[F.lit(v) for k, l in enumerate(model.languages) for v in (l, k)])
    looked = seen.unionByName(by_grams).withColumn("langs", F.transform("langs", lambda l: F.element_at(place, l)))
    looked = written(looked, "looked-up-words")
    discard(found, split, places, wanted, hits)
    return looked


def _spread_over(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each element of an array of lists, null or not, the list it is in; and the elements."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _finished(spark: SparkSession, model: LanguageModel):
    """The answer for a text's frequent part and what was looked up for its other words."""
    shared = spark.sparkContext.broadcast((model.languages, model.rest.base))

    @F.arrow_udf(_ANSWER)
    def finish(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        languages, base = shared.value
        k = len(languages)
        choose = LanguageModel(languages, {}, {}, np.zeros((0, k), np.float32)).surest
        for n_words, n_letters, n_frequent, known, langs, above, rest in batches:
            n = len(n_words)
            weights = np.zeros((n, len(base)))
            weights[:, 0] = n_frequent.to_numpy(zero_copy_only=False)
            known = known.to_numpy(zero_copy_only=False).astype(float)
            text, at = _spread_over(langs)
            total = np.bincount(text * k + at.to_numpy(zero_copy_only=False), above.flatten().to_numpy(zero_copy_only=False), n * k)
            text, words = _spread_over(rest)
            if len(words):
                times, letters, orders, langs, above = words.flatten()
                times = times.to_numpy(zero_copy_only=False).astype(float)
                known = known + np.bincount(text, times * letters.to_numpy(zero_copy_only=False), n)
                by_grams = orders.is_valid().to_numpy(zero_copy_only=False)
                weights[:, 0] += np.bincount(text[~by_grams], times[~by_grams], n)
                orders = orders.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(base))
                orders = orders / orders.sum(axis=1, keepdims=True)
                for j in range(1, len(base)):
                    weights[:, j] += np.bincount(text[by_grams], times[by_grams] * orders[:, j], n)
                word, lang = _spread_over(langs)
                above = above.flatten().to_numpy(zero_copy_only=False)
                total = total + np.bincount(text[word] * k + lang.to_numpy(zero_copy_only=False), times[word] * above, n * k)
            total = total.reshape(n, k) + weights @ base
            answers = [
                (*choose(own, size), size, size_letters, int(round(known_letters))) if size else (UNKNOWN, 0.0, 0, 0, 0)
                for own, size, size_letters, known_letters in zip(total, n_words.to_pylist(), n_letters.to_pylist(), known)
            ]
            yield _as_answers(answers)

    return finish


def identified(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, spent: bool = False
) -> DataFrame:
    """(row, answer) for each row of ``docs``: its columns as a struct, and the answer of ``predicted`` for its text.

    With ``keep`` the struct has those columns only; what is not kept, as the text, is not written in between. With
    ``spent`` the model is not used again: its written tables go once they are read.

    A model that is not whole takes joins of the texts' distinct words that are not broadcast, of their n-grams, and of
    what was found for them; words and n-grams that come often are spread over the tasks. Rows wait apart until the answers
    are written: no step that works on words or numbers has them with it.
    """
    spark = docs.sparkSession
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    if model.rest is None:
        return docs.select(row, predicted(spark, model, docs[text_col]).alias("answer"))
    part = _frequent_part(spark, model)(docs[text_col]).alias("part")
    scanned = written(docs.select(row, F.monotonically_increasing_id().alias("row_id"), part), "scanned-texts")
    rest = scanned.select("row_id", F.explode(F.arrays_zip("part.words", "part.times")).alias("w")).select(
        "row_id", F.col("w.words").alias("word"), F.col("w.times").alias("times")
    )
    n_rest = scanned.agg(F.coalesce(F.sum(F.size("part.words")), F.lit(0))).first()[0]
    looked = _looked_up(rest.groupBy("word").agg(F.count(F.lit(1)).alias("size")), model)
    if spent:
        discard(model.rest.words, model.rest.grams)
    release_shuffles(spark)
    parts = scanned.select("row_id", *[f"part.{c}" for c in ("n_words", "n_letters", "n_frequent", "n_known", "langs", "above")])
    answer = _finished(spark, model)("n_words", "n_letters", "n_frequent", "n_known", "langs", "above", "rest")
    answers = None
    for k in range(_ROUNDS):
        own = F.pmod(F.xxhash64("row_id"), F.lit(_ROUNDS)) == k
        gathered = join_groups(rest.filter(own), looked, "word", "size", n_rest).groupBy("row_id").agg(
            F.collect_list(F.struct("times", "letters", "orders", "langs", "above")).alias("rest")
        )
        some = written(parts.filter(own).join(gathered, "row_id", "left").select("row_id", answer.alias("answer")), "language-answers")
        answers = some if answers is None else answers.unionByName(some)
        release_shuffles(spark)
    discard(looked)
    return scanned.select("row", "row_id").join(answers.hint("shuffle_hash"), "row_id").select("row", "answer")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"], spent=True)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), F.col("answer.lang").alias("lang_pred"), F.col("answer.score").alias("score")
    )
