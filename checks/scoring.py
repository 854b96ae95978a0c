"""Scoring queue, replies and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import as_of, check, jobs, table, with_jobs
from checks.search import skills_sql
from listwright.functions.scalars import parse_reply, scoring_prompt
from listwright.plans import alerts, scoring


@check(
    "scoring_queue",
    with_jobs(
        """SELECT id, fetched_at, n FROM (SELECT id, fetched_at, row_number() OVER (ORDER BY fetched_at, id) AS n
        FROM jobs WHERE ai_score IS NULL AND ai_attempts < 5) WHERE n <= 40"""
    ),
)
def scoring_queue(spark, d):
    from pyspark.sql import Window

    queue = scoring.scoring_queue(jobs(spark, d), limit=40)
    n = F.row_number().over(Window.orderBy("fetched_at", "id")).cast("long")
    return queue.withColumn("n", n).select("id", "fetched_at", "n")


@check(
    "scoring_queue_all",
    with_jobs("SELECT id FROM jobs WHERE ai_score IS NULL AND ai_attempts < 5"),
)
def scoring_queue_all(spark, d):
    return scoring.scoring_queue(jobs(spark, d)).select("id")


def _prompt_sql(profile: str) -> str:
    return f"""'MY PROFILE:' || chr(10) || '{profile}' || chr(10) || chr(10)
      || 'JOB TO EVALUATE:' || chr(10) || 'Title: ' || title || chr(10)
      || 'Company: ' || coalesce(company, 'Unknown') || chr(10) || 'Source: ' || source || chr(10)
      || 'Location: ' || coalesce(location, 'Not specified') || chr(10)
      || 'Budget: ' || coalesce(budget, 'Not specified') || chr(10)
      || 'Tags: ' || CASE WHEN tags_csv = '' THEN 'none' ELSE replace(tags_csv, ',', ', ') END || chr(10) || chr(10)
      || 'Description:' || chr(10) || description || chr(10)"""


@check(
    "scoring_prompt",
    with_jobs(f"SELECT id, sha256({_prompt_sql('Maintainer of small things')}) AS prompt_hash FROM jobs"),
)
def prompt_rows(spark, d):
    prompt = scoring_prompt(F.lit("Maintainer of small things"))
    return jobs(spark, d).select("id", F.sha2(prompt, 256).alias("prompt_hash"))


# Replies of every kind, derived from the event table: fenced, chatty, out of range, text
# scores, missing scores, no JSON at all.
def replies(spark, d):
    score, kind, i = F.col("value"), F.col("event_type"), F.col("event_id")
    body = F.concat(F.lit('{"score": '), F.round(score, 1), F.lit(', "reason": " Reason '), i, F.lit('"}'))
    reply = (
        F.when(kind == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == "click", F.concat(F.lit("Sure! "), body, F.lit(" Anything else?")))
        .when(kind == "purchase", F.concat(
            F.lit('{"score": "'), F.round(score, 1), F.lit('", "reason": "r", "proposal": " Hello '), i, F.lit(' "}')))
        .when(kind == "error", F.concat(F.lit('{"reason": "no score '), i, F.lit('"}')))
        .otherwise(F.concat(F.lit("I would say "), F.round(score, 1)))
    )
    return table(spark, d, "events").select(i.alias("id"), reply.alias("reply"))


_PARSED = """SELECT event_id AS id,
    CASE WHEN event_type IN ('view', 'click', 'purchase')
      THEN CAST(greatest(0, least(10, round_even(round(value, 1), 0))) AS INTEGER) END AS score,
    CASE event_type WHEN 'view' THEN 'Reason ' || CAST(event_id AS VARCHAR)
      WHEN 'click' THEN 'Reason ' || CAST(event_id AS VARCHAR) WHEN 'purchase' THEN 'r' END AS reason,
    CASE WHEN event_type = 'purchase' THEN 'Hello ' || CAST(event_id AS VARCHAR)
      WHEN event_type IN ('view', 'click') THEN '' END AS proposal,
    CASE event_type WHEN 'error' THEN 'score missing' WHEN 'signup' THEN 'not json' END AS error
  FROM events"""


@check("parse_model_reply", _PARSED)
def parse_model_reply(spark, d):
    return replies(spark, d).select("id", parse_reply("reply").alias("r")).select("id", "r.*")


@check(
    "scoring_fold",
    with_jobs(
        f"""SELECT j.id, coalesce(r.score, j.ai_score) AS ai_score,
          CASE WHEN r.score IS NOT NULL THEN r.reason ELSE j.ai_reason END AS ai_reason,
          CASE WHEN r.score IS NOT NULL THEN coalesce(j.ai_proposal, r.proposal) ELSE j.ai_proposal END AS ai_proposal,
          CAST(j.ai_attempts + CASE WHEN r.error IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS ai_attempts
        FROM jobs j LEFT JOIN ({_PARSED}) r ON r.id = j.id"""
    ),
)
def scoring_fold(spark, d):
    return scoring.fold_replies(jobs(spark, d), replies(spark, d)).select(
        "id", "ai_score", "ai_reason", "ai_proposal", "ai_attempts"
    )


@check(
    "rescore_fold",
    with_jobs(
        f"""SELECT j.id, CASE WHEN r.score IS NOT NULL THEN r.proposal ELSE j.ai_proposal END AS ai_proposal,
          CAST(CASE WHEN r.score IS NOT NULL THEN 0 WHEN r.error IS NOT NULL THEN j.ai_attempts + 1
            ELSE j.ai_attempts END AS INTEGER) AS ai_attempts
        FROM jobs j LEFT JOIN ({_PARSED}) r ON r.id = j.id"""
    ),
)
def rescore_fold(spark, d):
    folded = scoring.fold_replies(jobs(spark, d), replies(spark, d), explicit=True)
    return folded.select("id", "ai_proposal", "ai_attempts")


@check(
    "scoring_outcome",
    """SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'scored' ELSE 'failed' END AS outcome,
      count(*) AS n FROM events GROUP BY 1""",
)
def scoring_outcome(spark, d):
    return scoring.scoring_outcome(replies(spark, d))


_SKILLS = ["python", "api", "kubernetes", "web"]
_LOW = "lower(title || chr(10) || description || chr(10) || tags_text)"


@check(
    "overlap_scores",
    with_jobs(
        f"""SELECT id, CAST(round_even(10.0 * n / 4, 0) AS INTEGER) AS score,
          trim('Skills found: ' || replace(hits, ',', ', ')) AS reason FROM (
          SELECT id, hits, CASE WHEN hits = '' THEN 0 ELSE len(string_split(hits, ',')) END AS n FROM (
            SELECT id, {skills_sql(_SKILLS, _LOW)} AS hits FROM jobs WHERE ai_score IS NULL AND ai_attempts < 5))"""
    ),
)
def overlap_scores(spark, d):
    queue = scoring.scoring_queue(jobs(spark, d))
    parsed = scoring.overlap_replies(queue, _SKILLS).select("id", parse_reply("reply").alias("r"))
    return parsed.select("id", "r.score", "r.reason")


@check(
    "scorer_plugin",
    with_jobs(
        f"""SELECT id, CAST(length({_prompt_sql('profile')}) % 11 AS INTEGER) AS score, 'by length' AS reason
        FROM jobs WHERE ai_score IS NULL AND ai_attempts < 5"""
    ),
)
def scorer_plugin(spark, d):
    """A scorer that runs inside the tasks and goes by the length of what it is asked."""

    def by_length(batches):
        import json

        for batch in batches:
            score = batch["prompt"].str.len() % 11
            batch["reply"] = [json.dumps({"score": int(s), "reason": "by length"}) for s in score]
            yield batch[["id", "reply"]]

    asked = scoring.ask(scoring.scoring_queue(jobs(spark, d)), by_length, "profile")
    return asked.select("id", parse_reply("reply").alias("r")).select("id", "r.score", "r.reason")


@check(
    "alert_outbox",
    with_jobs(
        """SELECT id, ai_score, fetched_at, '⭐ ' || CAST(ai_score AS VARCHAR) || '/10 — ' || title
            || coalesce(chr(10) || company, '') || coalesce(chr(10) || ai_reason, '') || chr(10) || url AS message
        FROM (SELECT *, row_number() OVER (ORDER BY ai_score DESC, fetched_at DESC, id) AS n FROM jobs
          WHERE ai_score >= 8 AND notified_at IS NULL AND status <> 'ignored'
            AND id NOT IN (SELECT id FROM jobs WHERE status = 'won')) WHERE n <= 20"""
    ),
)
def alert_outbox(spark, d):
    rows = jobs(spark, d)
    # Listings that were won have been in the outbox before.
    return alerts.select_alerts(rows, rows.filter("status = 'won'").select("id"))
