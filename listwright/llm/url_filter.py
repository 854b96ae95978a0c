"""URL filter: host and path rules, and a character language-model ratio for the urls that no rule covers.

Two variable-order Markov models over characters, one of accepted and one of rejected urls, are counted from the urls
that the rules decide. A url's score is the log-likelihood difference of the two, divided by its length; the threshold
is calibrated on ruled urls that the models did not see.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import ascii_lower, query, table, written

START, END = "\x02", "\x03"
#: Longest gram: a character after up to ORDER - 1 characters of context.
ORDER = 5
#: Below all contexts every character is equally likely.
ALPHABET = 256
#: One ruled url in so many (by a hash of host and path) calibrates the threshold instead of training the models.
CALIBRATION = 5
#: Likelihoods are kept in millionths, as integers, so that sums do not depend on their order.
UNIT = 1_000_000
#: Score bins a nat per character when the threshold is sought.
BINS = 1000
#: The rows of frequent grams are spread over so many keys.
SALTS = 8
#: How grams and urls are joined. Left to itself Spark broadcasts through the driver what was small when it was shuffled,
#: however much larger it is by then: ratios are multiplied by the salts.
DEALT = "shuffle_hash"


@dataclass(frozen=True)
class Rule:
    """Covers a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first ://, up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        at_home = (host == rule.host) | host.endswith("." + rule.host)
        found = F.when(at_home & path.startswith(rule.path), rule.name).otherwise(found)
    return found


def grams(text: Column) -> Column:
    """For each character and the end of ``text``, it with the ORDER - 1 characters before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: padded.substr(i, F.lit(ORDER)))


def count_grams(urls: DataFrame) -> DataFrame:
    """(gram, a, r): how often each longest gram occurs in accepted and rejected urls that train; all grams of all urls."""
    ones = urls.select(
        F.explode(grams(F.col("scored"))).alias("gram"),
        (F.col("trains") & (F.col("ruled") == "allow")).cast("long").alias("a"),
        (F.col("trains") & (F.col("ruled") == "block")).cast("long").alias("r"),
    )
    return ones.groupBy("gram").agg(F.sum(F.coalesce("a", F.lit(0))).alias("a"), F.sum(F.coalesce("r", F.lit(0))).alias("r"))


def gram_ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood of the last character after the others, accepted less rejected, in UNITs.

    Witten-Bell smoothing from the empty context to the longest: a context with n characters seen, of t kinds, gives
    the shorter context's estimate the weight t / (n + t). A context that was never seen leaves that estimate as it is.
    """
    below = None
    for k in range(1, ORDER + 1):
        level = counted.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        level = level.withColumn("context", F.expr(f"left(gram, {k - 1})"))
        contexts = level.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"),
        )
        level = level.join(contexts.hint(DEALT), "context")
        if below is None:
            level = level.withColumn("pa0", F.lit(1.0 / ALPHABET)).withColumn("pr0", F.lit(1.0 / ALPHABET))
        else:
            shorter = below.select(F.col("gram").alias("short"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
            level = level.join(shorter.hint(DEALT), F.expr(f"right(gram, {k - 1})") == F.col("short"))
        estimate = lambda c: F.when(F.col("n" + c) == 0, F.col(f"p{c}0")).otherwise(
            (F.col(c) + F.col("t" + c) * F.col(f"p{c}0")) / (F.col("n" + c) + F.col("t" + c))
        )
        below = level.select("gram", estimate("a").alias("pa"), estimate("r").alias("pr"))
    return below.select("gram", F.round((F.ln("pa") - F.ln("pr")) * UNIT).cast("long").alias("ratio"))


def score_urls(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(key, score): mean of the grams' ratios of each url. Frequent grams are salted; none pass through the driver."""
    salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ones = urls.select("key", F.explode(grams(F.col("scored"))).alias("gram")).withColumn(
        "salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    )
    return ones.join(salted.hint(DEALT), ["gram", "salt"]).groupBy("key").agg(
        (F.sum("ratio") / F.count(F.lit(1)) / UNIT).alias("score")
    )


def best_threshold(scored: DataFrame) -> float:
    """The score that divides the calibration urls best: most of (accepted at or above) + (rejected below), as shares.

    The scores are counted in bins of fixed width, so the driver gets as many rows as there are bins with urls, and
    scores are differences of log probabilities that Witten-Bell estimates keep within a few nats. Without urls of both
    kinds the threshold is 0, where both models find a url as likely.
    """
    bins = sorted(
        scored.filter("calibrates").groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(
            F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r")
        ).collect()
    )
    accepted, rejected = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    if not accepted or not rejected:
        return 0.0
    best, at, a, r = -math.inf, 0.0, accepted, 0
    for b in bins:  # thresholds below each bin
        share = a / accepted + r / rejected
        # Of equally good ones, that nearest to 0.
        if (share, -abs(b["bin"])) > (best, -abs(at)):
            best, at = share, b["bin"]
        a, r = a - b["a"], r + b["r"]
    return at / BINS


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold), a row for each row of ``pages``.

    The verdict is the longest fitting rule's, else allow where the score is at or above the threshold and block below.
    Null urls and those without :// have an empty host and path, fit no rule, and are scored as empty strings: by the
    end mark alone. Without any ruled urls all scores and the threshold are 0, and everything is allowed. Rows repeated
    get the same answer each; they count as often as they occur. Other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.name, rule.verdict).otherwise(verdicts)
    urls = urls.withColumn("ruled", verdicts).withColumn("scored", F.concat("host", "path"))
    held = F.pmod(F.xxhash64("scored"), F.lit(CALIBRATION)) == 0
    urls = written(
        urls.select(
            F.monotonically_increasing_id().alias("key"), "*",
            (F.col("ruled").isNotNull() & ~held).alias("trains"), (F.col("ruled").isNotNull() & held).alias("calibrates"),
        ),
        "urls",
    )
    ratios = gram_ratios(written(count_grams(urls), "url-grams"))
    scored = written(urls.join(score_urls(urls, ratios).hint(DEALT), "key"), "url-scores")
    threshold = best_threshold(scored)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
