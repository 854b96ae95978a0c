"""Ranked keyword search over listings, for one query or for a table of queries.

Meaning of a query: bare words are hints, the last term is what is looked for and counts
double, "quoted phrases" are required, -words exclude. A listing that has only some of the
terms, and those only in its description, is no result. Rare terms weigh a little more,
neighbouring terms earn a bonus, and with two or more terms results far below the best one
are dropped.

Both forms produce the same thin *hits* (one row per query and surviving listing, with one
bit mask of fields per term) and share the ranking.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright import fixed_values as fv
from listwright.functions.text import END, START, bind, escape, text_or_empty
from listwright.operators.postings import LITERAL, LOOSE, SEPARATOR, postings, votes
from listwright.operators.probes import field_mask
from listwright.session import cut_lineage, keep_computed, written

# One bit per field; the description is the weakest evidence.
BITS = {"title": 8, "tags": 4, "company": 2, "description": 1}
_WEIGHT = {bit: fv.FIELD_WEIGHTS[name] for name, bit in BITS.items()}


# ------------------------------------------------------------------ reading a query
@dataclass(frozen=True)
class Term:
    text: str
    required: bool = False

    @property
    def forms(self) -> list[str]:
        """The term and the spellings that count as the same."""
        if self.required:
            return [self.text]
        key = self.text.lower()
        squashed = re.sub("[^a-z0-9]", "", key)
        forms = [self.text, *fv.ALIASES.get(key, [])]
        return list(dict.fromkeys(forms + fv.ALIASES.get(squashed, [])))

    @property
    def pattern(self) -> str:
        return "(?iu)" + "|".join(_form_pattern(f) for f in self.forms)


@dataclass(frozen=True)
class Query:
    terms: list[Term] = field(default_factory=list)
    excluded: list[Term] = field(default_factory=list)

    @property
    def whole_pattern(self) -> str:
        return _adjacent(self.terms)

    @property
    def pair_patterns(self) -> list[str]:
        return [_adjacent(list(pair)) for pair in zip(self.terms, self.terms[1:])]


def _form_pattern(form: str) -> str:
    """One spelling as a whole word; edges next to punctuation are left open."""
    body = SEPARATOR.join(escape(part) for part in form.split())
    before = START if form[0].isalnum() else ""
    after = fv.SEARCH_SUFFIX + END if form[-1].isalnum() else ""
    return before + body + after


def _adjacent(terms: list[Term]) -> str:
    """The terms next to each other, in order, as whole words."""
    words = ["(?:" + "|".join(escape(f) for f in t.forms) + ")" for t in terms]
    return "(?iu)" + START + SEPARATOR.join(words) + END


def read_query(q: str | None, max_terms: int | None = None) -> Query:
    """Split a query into terms and exclusions. Pieces without letter or digit say nothing.

    All of them count. With ``max_terms``, reading ends at the bare word that makes so many terms.
    """
    query = Query()
    for piece in re.findall(r'-"[^"]+"|"[^"]+"|-?\S+', q or ""):
        negative = piece.startswith("-") and bool(re.search("[A-Za-z0-9]", piece[1:]))
        body = piece[1:] if negative else piece
        quoted = len(body) > 2 and body[0] == body[-1] == '"' and '"' not in body[1:-1]
        text = body[1:-1].strip() if quoted else body
        if not re.search("[A-Za-z0-9]", text):
            continue
        if negative:
            query.excluded.append(Term(text, required=True))
            continue
        query.terms.append(Term(text, required=quoted))
        if max_terms is not None and not quoted and len(query.terms) >= max_terms:
            break
    return query


# ------------------------------------------------------------------ hits of one query
def _text_columns(df: DataFrame) -> dict[int, Column]:
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return {
        BITS["title"]: text_or_empty("title"),
        BITS["tags"]: tags,
        BITS["company"]: text_or_empty("company"),
        BITS["description"]: text_or_empty("description"),
    }


def _may_contain(blob: Column, forms: list[str]) -> Column:
    """Cheap necessary condition: all parts of some form occur somewhere."""
    possible = F.lit(False)
    for form in forms:
        parts = F.lit(True)
        for part in form.lower().split():
            parts &= F.contains(blob, F.lit(part))
        possible |= parts
    return possible


def _survives(masks: Column, required: Column, n_terms: Column) -> Column:
    """Which listings are results: see the module text."""
    matched = F.size(F.filter(masks, lambda m: m > 0))
    strong = F.exists(masks, lambda m: m > 1)
    missing = F.exists(F.zip_with(masks, required, lambda m, r: r & (m == 0)), lambda x: x)
    return ~missing & (matched > 0) & ((matched >= n_terms) | strong)


def hits_of_query(df: DataFrame, query: Query) -> DataFrame:
    """Listings that survive the matching rules, with ``masks``, ``whole`` and ``pairs``."""
    # The texts are prepared in a step of their own, so they are computed once per row.
    texts = {bit: F.col(f"_f{bit}") for bit in BITS.values()}
    rows = df.withColumns({f"_f{bit}": c for bit, c in _text_columns(df).items()})
    rows = rows.withColumn("_blob", F.lower(F.concat_ws(" \n ", *texts.values())))

    def mask_of(pattern: str, forms: list[str]) -> Column:
        found = field_mask(texts, lambda text: text.rlike(pattern))
        return F.when(_may_contain(F.col("_blob"), forms), found).otherwise(F.lit(0))

    for term in query.excluded:
        rows = rows.filter(mask_of(term.pattern, term.forms) == 0)
    if not query.terms:
        return rows.select(*df.columns)

    n = len(query.terms)
    masks = F.array(*[mask_of(t.pattern, t.forms) for t in query.terms])
    required = F.array(*[F.lit(t.required) for t in query.terms])
    kept = bind(masks, lambda m: F.when(_survives(m, required, F.lit(n)), m))
    rows = keep_computed(rows, "masks", kept)
    # Adjacency only matters where at least two terms were found.
    several = F.size(F.filter("masks", lambda m: m > 0)) > 1
    zero = F.lit(0)
    adjacent = lambda p: F.when(several, field_mask(texts, lambda t: t.rlike(p))).otherwise(zero)
    whole = adjacent(query.whole_pattern) if n > 1 else zero
    pairs = F.array(*[adjacent(p) for p in query.pair_patterns]).cast("array<int>")
    return rows.withColumns({"whole": whole, "pairs": pairs}).select(
        *df.columns, "masks", "whole", "pairs"
    )


# ------------------------------------------------------------------ ranking
def _by_mask(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _term_values() -> list[float]:
    """Value of a term for each of the 16 sets of fields it was found in."""
    out = []
    for mask in range(16):
        weights = [w for bit, w in _WEIGHT.items() if mask & bit] or [0.0]
        out.append(max(weights) + fv.EXTRA_FIELD_FACTOR * (sum(weights) - max(weights)))
    return out


def _weight_sums() -> list[float]:
    return [sum(w for bit, w in _WEIGHT.items() if mask & bit) for mask in range(16)]


def _pick(table: Column, mask: Column) -> Column:
    return F.element_at(table, mask + 1)


def _score(masks: Column, whole: Column, pairs: Column, idf: Column) -> Column:
    values, sums = _by_mask(_term_values()), _by_mask(_weight_sums())
    n = F.size(masks)
    terms = F.aggregate(
        F.transform(
            masks,
            lambda m, i: _pick(values, m) * F.element_at(idf, i + 1)
            * F.when((n > 1) & (i == n - 1), fv.HEAD_BOOST).otherwise(1.0),
        ),
        F.lit(0.0), lambda acc, x: acc + x,
    )
    # A field with the whole phrase earns the phrase bonus, any other its pairs.
    elsewhere = F.lit(15) - whole
    adjacency = fv.PHRASE_FACTOR * n * _pick(sums, whole) + fv.ADJACENT_PAIR_FACTOR * F.aggregate(
        pairs, F.lit(0.0), lambda acc, p: acc + _pick(sums, p.bitwiseAND(elsewhere))
    )
    several = F.size(F.filter(masks, lambda m: m > 0)) > 1
    return terms + F.when(several, adjacency).otherwise(0.0)


def rank_hits(hits: DataFrame, key: str = "query_id", few_queries: bool = True) -> DataFrame:
    """Adds ``relevance`` and drops what is below the floor of its query.

    Term frequencies and best scores are partial aggregates (a query that matches a third of
    all listings is added up before the shuffle). Their results have one row per query; they
    are broadcast when the caller knows there are few queries, else joined by shuffle, where
    adaptive execution splits a hot query.
    """
    small = F.broadcast if few_queries else (lambda d: d)
    per_term = (
        hits.select(key, F.posexplode("masks").alias("pos", "mask"))
        .groupBy(key, "pos")
        .agg(F.count("*").alias("n"), F.count_if(F.col("mask") > 0).alias("df"))
    )
    damped = 1.0 + fv.IDF_INFLUENCE * (F.log(1.0 + F.col("n") / (1.0 + F.col("df"))) - 1.0)
    idf = per_term.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("pos", F.greatest(F.lit(fv.IDF_MINIMUM), damped).alias("idf")))
        ).alias("_idf")
    )
    scored = (
        hits.join(small(idf), key)
        .withColumn(
            "relevance",
            _score(F.col("masks"), F.col("whole"), F.col("pairs"), F.transform("_idf", lambda x: x["idf"])),
        )
        .withColumn("_terms", F.size("masks"))
        .drop("_idf", "masks", "whole", "pairs")
    )
    best = scored.filter("_terms > 1").groupBy(key).agg(F.max("relevance").alias("_best"))
    kept = scored.join(small(best), key, "left").filter(
        F.col("_best").isNull() | (F.col("relevance") >= fv.RELATIVE_FLOOR * F.col("_best"))
    )
    return kept.drop("_terms", "_best")


def search(df: DataFrame, q: str | None) -> DataFrame:
    """Filter and score listings for one query: adds ``relevance``.

    An empty query keeps everything, a query of exclusions keeps the survivors; neither has
    scores (NULL). Hits are materialised once, because ranking reads them three times and
    the matching is by far the most work. Select the columns you need before calling.
    """
    query = read_query(q)
    no_score = F.lit(None).cast("double").alias("relevance")
    if not query.terms:
        return (hits_of_query(df, query) if query.excluded else df).select("*", no_score)
    hits = cut_lineage(hits_of_query(df, query).withColumn("query_id", F.lit(1)))
    return rank_hits(hits).drop("query_id")


# ------------------------------------------------------------------ a table of queries
_PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("required", T.BooleanType()),
            T.StructField("form", T.StringType()),
            T.StructField("mode", T.StringType()),
            T.StructField("n", T.IntegerType()),
        ]
    )
)


@F.pandas_udf(_PARTS)
def _parts_of(q: pd.Series) -> pd.Series:
    """The forms a query asks for: of its terms, of what it excludes, and of its terms as neighbours of each other."""

    def one(text: str | None) -> list[dict]:
        query = read_query(text)
        n = len(query.terms)
        asked = [("term", LOOSE, query.terms), ("exclude", LOOSE, query.excluded)]
        if n > 1:
            asked.append(("neighbour", LITERAL, query.terms))
        return [
            {"role": role, "pos": i, "required": term.required, "form": form, "mode": mode, "n": n}
            for role, mode, terms in asked for i, term in enumerate(terms) for form in term.forms
        ]

    return q.map(one)


_VERDICT = T.StructType(
    [
        T.StructField("masks", T.ArrayType(T.IntegerType())),
        T.StructField("pairs", T.ArrayType(T.IntegerType())),
        T.StructField("whole", T.IntegerType()),
        T.StructField("excluded", T.BooleanType()),
    ]
)
_BETWEEN = re.compile(r"[\s\x85\xa0\u2007\u202f_\-/]+")


def _judged(rows: list[dict]) -> dict:
    """What one query finds in one listing, from the words that speak for its forms."""
    spoken: dict[tuple, dict] = {}
    for r in rows:
        spoken.setdefault((r["role"], r["pos"], r["unit"], r["bit"], r["start"]), {})[r["j"]] = r
    n = rows[0]["n"]
    masks, excluded = [0] * n, False
    # Of each field and term, where its spellings begin and end.
    spans: dict[int, list[list]] = {}
    for (role, pos, _, bit, start), words in spoken.items():
        k = next(iter(words.values()))["k"]
        if len(words) < k:
            continue
        if role == "exclude":
            excluded = True
        elif role == "term":
            masks[pos] |= bit
        else:
            first, last = words[0], words[k - 1]
            spans.setdefault(bit, [[] for _ in range(n)])[pos].append(
                (start, start + k - 1, first["free_start"], last["free_end"], first["before"], first["lead_chars"], last["trail_chars"])
            )
    pairs, whole = [0] * max(n - 1, 0), 0
    for bit, terms in spans.items():
        # Ends up to which the terms so far have been found as a chain.
        reached = {end for _, end, free, *_ in terms[0] if free}
        for i in range(n - 1):
            ends: dict[int, list] = {}
            for _, end, free, _, _, _, trail in terms[i]:
                ends.setdefault(end, []).append((free, trail))
            here = set()
            for start, end, _, free_end, before, lead, _ in terms[i + 1]:
                for free, trail in ends.get(start - 1, ()):
                    if _BETWEEN.fullmatch(before[1 + trail:len(before) - lead]):
                        if free and free_end:
                            pairs[i] |= bit
                        if start - 1 in reached and (i < n - 2 or free_end):
                            here.add(end)
            reached = here
        if n > 1 and reached:
            whole |= bit
    return {"masks": masks, "pairs": pairs, "whole": whole, "excluded": excluded}


_NOT_ASKED = {"masks": [], "pairs": [], "whole": 0, "excluded": False}


@F.pandas_udf(_VERDICT)
def _judge(rows: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_NOT_ASKED if r is None else _judged(list(r)) for r in rows], columns=_VERDICT.names)


def _may_be_near() -> Column:
    """Of a group of rows as ``_judged`` gets them: whether positions matter, because a form has several words or a field
    has several terms, which could be neighbours."""
    here = lambda bit: F.when((F.col("role") == "neighbour") & (F.col("bit") == bit), F.col("pos"))
    near = F.max("k") > 1
    for bit in BITS.values():
        near |= F.coalesce(F.max(here(bit)) > F.min(here(bit)), F.lit(False))
    return near


def _verdict() -> Column:
    """What ``_judged`` says of ``rows``. Python is asked where positions matter only, which is for few of the pairs."""
    rows, n = F.col("rows"), F.element_at("rows", 1)["n"]
    no_bits = F.array_repeat(F.lit(0), n)

    def mask(none: Column, i: Column) -> Column:
        found = F.filter(rows, lambda r: (r["role"] == "term") & (r["pos"] == i))
        return F.aggregate(found, none, lambda bits, r: bits.bitwiseOR(r["bit"]))

    alone = F.struct(
        F.transform(no_bits, mask).alias("masks"), F.array_repeat(F.lit(0), n - 1).alias("pairs"), F.lit(0).alias("whole"),
        F.exists(rows, lambda r: r["role"] == "exclude").alias("excluded"),
    )
    return F.when(F.col("near"), _judge(F.when(F.col("near"), rows))).otherwise(alone)


def listing_index(listings: DataFrame) -> DataFrame:
    """Postings of the fields that are searched; write them as a table to search it more than once."""
    texts = listings.select("id", *[c.alias(f"f{bit}") for bit, c in _text_columns(listings).items()])
    return postings(texts, {bit: f"f{bit}" for bit in BITS.values()})


def search_batch(listings: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, id, relevance) for every query of (query_id, q), as ``search`` gives for each alone.

    Forms are looked up in ``index``, the postings of the listings, made here if not given: nothing is matched against
    texts. Queries without terms have no scores (NULL) and keep all listings but those they exclude: for them the result
    is as large as the listings. What several queries ask for is looked up once.
    """
    parts = written(
        queries.select("query_id", F.inline(_parts_of("q"))).withColumn("unit", F.concat_ws(" ", "mode", "form")),
        "search-parts",
    )
    terms = parts.filter("role = 'term'").groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct("pos", "required"))), lambda x: x["required"]
        ).alias("required")
    )
    spoken = votes(listing_index(listings) if index is None else index, parts.select("unit", "form", "mode").distinct())
    asked = parts.select("query_id", "unit", "role", "pos", "n")
    rows = spoken.join(asked, "unit")
    # A group is what one query asks for in one listing: no larger than the listing's text.
    row = F.struct(*[c for c in rows.columns if c not in ("query_id", "id")])
    found = written(
        rows.groupBy("query_id", "id").agg(F.collect_list(row).alias("rows"), _may_be_near().alias("near"))
        .select("query_id", "id", F.explode(F.array(_verdict())).alias("v")).select("query_id", "id", "v.*"),
        "search-found",
    )
    hits = (
        found.filter("not excluded and size(masks) > 0").join(terms, "query_id")
        .filter(_survives(F.col("masks"), F.col("required"), F.size("required")))
        .select("query_id", "id", "masks", "whole", "pairs")
    )
    ranked = rank_hits(hits, few_queries=False)
    excluded = found.filter("excluded").select("query_id", "id")
    for block in _without_terms(queries, terms):
        kept = listings.select(F.explode(F.lit(block)).alias("query_id"), "id")
        kept = kept.join(excluded, ["query_id", "id"], "left_anti")
        ranked = ranked.unionByName(kept.withColumn("relevance", F.lit(None).cast("double")))
    return ranked


def _without_terms(queries: DataFrame, terms: DataFrame) -> Iterator[list]:
    """Ids of the queries that have no term, in blocks."""
    ids = queries.select("query_id").join(terms.select("query_id"), "query_id", "left_anti").distinct()
    block = []
    for row in ids.toLocalIterator():
        block.append(row["query_id"])
        if len(block) == _QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


# Queries without terms that are laid over the listings at once.
_QUERY_BLOCK = 1_000
