"""Scoring queue: what to score next, replies, and folding them into the listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.scalars import parse_reply, scoring_prompt
from listwright.functions.text import empty_to_null
from listwright.operators.match import clean_skills, match_text, skills_found
from listwright.operators.predicates import unscored_and_retryable

# A scorer turns batches of (id, prompt) into batches of (id, reply); reply is raw text.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def scoring_queue(listings: DataFrame, limit: int = 0) -> DataFrame:
    """Unscored listings, oldest first; listings that failed too often are left out.

    A limit of 0 means all of them.
    """
    queue = listings.filter(unscored_and_retryable()).orderBy("fetched_at", "id")
    return queue.limit(limit) if limit > 0 else queue


def ask(queue: DataFrame, scorer: Scorer, profile: str) -> DataFrame:
    """(id, reply): the scorer runs inside the tasks, one batch of prompts at a time."""
    prompts = queue.select("id", scoring_prompt(F.lit(profile)).alias("prompt"))
    return prompts.mapInPandas(scorer, "id bigint, reply string")


def overlap_replies(queue: DataFrame, skills: list[str]) -> DataFrame:
    """(id, reply) of the built-in scorer: the share of skills found, scaled to 0..10."""
    wanted = clean_skills(skills)
    rows = queue.withColumn("_low", match_text()).withColumn(
        "hits", skills_found(F.col("_low"), wanted)
    )
    score = F.least(F.lit(10), F.bround(10.0 * F.size("hits") / max(1, len(wanted)), 0).cast("int"))
    reason = F.concat(F.lit("Skills found: "), F.array_join("hits", ", "))
    reply = F.to_json(
        F.struct(score.alias("score"), reason.alias("reason"), F.lit("").alias("proposal"))
    )
    return rows.select("id", reply.alias("reply"))


def fold_replies(listings: DataFrame, replies: DataFrame, explicit: bool = False) -> DataFrame:
    """Listings with replies folded in.

    A good reply sets score and reason. A proposal somebody wrote is kept unless the
    scoring was asked for explicitly, which also clears the failure count. A bad reply
    counts as one more failed attempt and changes nothing else.
    """
    parsed = replies.select("id", parse_reply("reply").alias("_r"))
    rows = listings.join(parsed, "id", "left")
    good = F.col("_r.score").isNotNull()
    bad = F.col("_r.error").isNotNull()
    kept = F.lit(None).cast("string") if explicit else empty_to_null("ai_proposal")
    attempts = F.when(bad, F.col("ai_attempts") + 1).otherwise(F.col("ai_attempts"))
    return rows.withColumns(
        {
            "ai_score": F.coalesce("_r.score", "ai_score"),
            "ai_reason": F.when(good, F.col("_r.reason")).otherwise(F.col("ai_reason")),
            "ai_proposal": F.when(good, F.coalesce(kept, "_r.proposal"))
            .otherwise(F.col("ai_proposal")),
            "ai_attempts": F.when(good, F.lit(0)).otherwise(attempts) if explicit else attempts,
        }
    ).drop("_r")


def scoring_outcome(replies: DataFrame) -> DataFrame:
    """(outcome, n): how many replies were scored and how many failed."""
    failed = parse_reply("reply")["error"].isNotNull()
    return (
        replies.select(F.when(failed, "failed").otherwise("scored").alias("outcome"))
        .groupBy("outcome").agg(F.count("*").alias("n"))
    )


def score_log_events(replies: DataFrame, at: Column) -> DataFrame:
    """Replies as lifecycle events ('score' or 'score_failed'), to be appended to the log."""
    # Replies to one listing at the same time are events of their own.
    rows = replies.select("id", F.xxhash64("id", "reply").alias("seq"), parse_reply("reply").alias("r"))
    return rows.select(
        F.col("id").alias("job_id"), at.alias("ts"), F.col("seq"),
        F.when(F.col("r.error").isNull(), "score").otherwise("score_failed").alias("kind"),
        F.lit(None).cast("string").alias("status"), F.col("r.proposal").alias("text"),
        F.col("r.score").alias("score"), F.col("r.reason").alias("reason"),
    )
