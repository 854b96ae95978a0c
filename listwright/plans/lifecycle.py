"""Status workflow as an append-only event log and a fold to the current state.

Event columns: job_id, ts, seq, kind, status, text, score. Kinds: shortlist, ignore, apply,
move (status), proposal (text), notes (text), score / rescore (score, reason, text = drafted
proposal), score_failed.

Every part of the state is a max / max_by / min, so a listing that has a third of all
events is added up inside the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions.text import empty_to_null

EVENT_SCHEMA = (
    "job_id bigint, ts timestamp_ntz, seq bigint, kind string, status string, "
    "text string, score int, reason string"
)


def event_order() -> Column:
    """(ts, seq) as one number: a fixed-width buffer keeps the aggregation hash based."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return micros.cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("seq")


def _code(status: Column) -> Column:
    position = F.array_position(F.array(*map(F.lit, fv.STATUSES)), status)
    return F.when(position > 0, position.cast("int"))


def _status(code: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, fv.STATUSES)), code)


def fold_status(events: DataFrame) -> DataFrame:
    """(job_id, status, applied_at, last_apply, first_move): the last valid status, and when
    it was applied for.

    An 'apply' always sets the time; a move to 'applied' only where there is none yet. So it
    is the last apply if there is one, else the first such move.
    """
    kind = F.col("kind")
    moved_to = F.when(kind == "move", _code(F.col("status")))
    code = (
        F.when(kind == "shortlist", F.lit(fv.STATUSES.index("shortlisted") + 1))
        .when(kind == "ignore", F.lit(fv.STATUSES.index("ignored") + 1))
        .when(kind == "apply", F.lit(fv.STATUSES.index("applied") + 1))
        .otherwise(moved_to)
    )
    rows = events.select("job_id", "ts", kind, code.alias("code"), event_order().alias("ord"))
    changes = rows.filter(F.col("code").isNotNull())
    applied = F.col("code") == fv.STATUSES.index("applied") + 1
    return changes.groupBy("job_id").agg(
        F.max_by("code", "ord").alias("code"),
        F.max_by(F.when(kind == "apply", F.col("ts")), F.when(kind == "apply", F.col("ord"))).alias("last_apply"),
        F.min_by(
            F.when(applied & (kind == "move"), F.col("ts")),
            F.when(applied & (kind == "move"), F.col("ord")),
        ).alias("first_move"),
    ).select(
        "job_id", _status(F.col("code")).alias("status"),
        F.coalesce("last_apply", "first_move").alias("applied_at"), "last_apply", "first_move",
    )


def fold_texts(events: DataFrame) -> DataFrame:
    """(job_id, notes, ai_proposal, ai_score, ai_reason): last write wins.

    A first scoring leaves a proposal the user has written alone; an explicit rescore or an
    edit replaces whatever is there.
    """
    kind, order = F.col("kind"), event_order()
    latest = lambda value, kinds: F.max_by(
        F.when(kind.isin(kinds), F.col(value)), F.when(kind.isin(kinds), order)
    )
    last_at = lambda kinds: F.max(F.when(kind.isin(kinds), order))
    replacing = ["proposal", "rescore"]
    folded = events.groupBy("job_id").agg(
        latest("text", ["notes"]).alias("notes"),
        latest("text", replacing).alias("replaced"), last_at(replacing).alias("replaced_at"),
        latest("text", ["score"]).alias("drafted"), last_at(["score"]).alias("drafted_at"),
        latest("score", ["score", "rescore"]).alias("ai_score"),
        latest("reason", ["score", "rescore"]).alias("ai_reason"),
        F.bool_or(kind == "rescore").alias("rescored"),
    )
    keep = (F.col("replaced_at") > F.col("drafted_at")) | F.col("drafted_at").isNull()
    proposal = F.when(keep, F.col("replaced")).otherwise(
        F.coalesce(empty_to_null(F.col("replaced")), F.col("drafted"))
    )
    return folded.select(
        "job_id", "notes", proposal.alias("ai_proposal"), "ai_score", "ai_reason", "rescored",
        F.col("replaced_at").isNotNull().alias("proposal_replaced"),
    )


# Parts a listing's failures are split into, so that none has to be counted in one task.
_SALTS = 16


def fold_attempts(events: DataFrame) -> DataFrame:
    """(job_id, ai_attempts): scoring failures since the last explicit rescore."""
    rows = events.select("job_id", "seq", "kind", event_order().alias("ord"))
    resets = rows.filter("kind = 'rescore'").groupBy("job_id").agg(F.max("ord").alias("reset"))
    resets = resets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    failures = rows.filter("kind = 'score_failed'").withColumn(
        "salt", F.pmod(F.xxhash64("ord"), F.lit(_SALTS)).cast("int")
    )
    since = failures.join(resets, ["job_id", "salt"], "left").filter(
        F.col("reset").isNull() | (F.col("ord") > F.col("reset"))
    )
    return (
        since.groupBy("job_id", "salt").agg(F.count("*").alias("n"))
        .groupBy("job_id").agg(F.sum("n").cast("int").alias("ai_attempts"))
    )


def current_state(listings: DataFrame, events: DataFrame) -> DataFrame:
    """Listings with the folded log laid over them. Three thin folds share the job key."""
    status, texts, attempts = fold_status(events), fold_texts(events), fold_attempts(events)
    folded = status.join(texts, "job_id", "full_outer").join(attempts, "job_id", "full_outer")
    over = folded.select(F.col("job_id").alias("id"),
                         *[F.col(c).alias(f"_{c}") for c in folded.columns if c != "job_id"])
    since = F.coalesce("_ai_attempts", F.lit(0))
    return (
        listings.join(over, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "applied_at": F.coalesce("_last_apply", "applied_at", "_first_move"),
                "notes": F.coalesce("_notes", "notes"),
                "ai_score": F.coalesce("_ai_score", "ai_score"),
                "ai_reason": F.coalesce("_ai_reason", "ai_reason"),
                # The written proposal of the table counts as an edit before all events.
                "ai_proposal": F.when(F.col("_proposal_replaced"), F.col("_ai_proposal"))
                .otherwise(F.coalesce(empty_to_null("ai_proposal"), "_ai_proposal")),
                "ai_attempts": F.when(F.col("_rescored"), since)
                .otherwise(F.col("ai_attempts") + since),
            }
        )
        .select(*listings.columns)
    )


# ------------------------------------------------------------------ board
def board_order() -> list[Column]:
    return [F.desc(F.coalesce("applied_at", "fetched_at")), F.asc("id")]


def board(listings: DataFrame) -> DataFrame:
    """Cards of all columns, column by column, newest first.

    One global (range-partitioned) sort: a column that holds most of the cards is still
    spread over many tasks.
    """
    column = F.array_position(F.array(*map(F.lit, fv.TRACKER_COLUMNS)), F.col("status")).cast("int")
    return (
        listings.filter(F.col("status").isin(fv.TRACKER_COLUMNS))
        .withColumn("column_ord", column)
        .orderBy("column_ord", *board_order())
    )


def board_counts(listings: DataFrame) -> DataFrame:
    """(status, n) for all board columns, empty ones included."""
    spark = listings.sparkSession
    columns = spark.createDataFrame(
        [(s, i + 1) for i, s in enumerate(fv.TRACKER_COLUMNS)], "status string, column_ord int"
    )
    counts = (
        listings.filter(F.col("status").isin(fv.TRACKER_COLUMNS))
        .groupBy("status").agg(F.count("*").alias("n"))
    )
    return F.broadcast(columns).join(counts, "status", "left").select(
        "status", "column_ord", F.coalesce("n", F.lit(0)).alias("n")
    )
