"""Queries over sessions and messages: filters, newest or oldest first, latest, latest per subject, tasks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import MESSAGE_COLUMNS, MOST_ROWS, FilterRequired, InvalidArgument, MessageFilter
from ..plans.registry import TASK_STATUSES


def condition(wanted: MessageFilter) -> Column:
    """Plain equalities, so that they reach the scan."""
    own = wanted.dimensions
    if not own:
        raise FilterRequired("at least one filter dimension is required")
    return reduce(and_, [F.col(k) == v for k, v in own.items()])


def get_messages(messages: DataFrame, wanted: MessageFilter) -> DataFrame:
    """Matching messages, oldest first; a limit keeps the oldest."""
    out = messages.where(condition(wanted)).select(*MESSAGE_COLUMNS).orderBy("created_at", "id")
    return out.limit(wanted.limit) if 0 < wanted.limit <= MOST_ROWS else out


def latest_message(messages: DataFrame, wanted: MessageFilter) -> DataFrame:
    """The newest matching message; no row if there is none."""
    return messages.where(condition(wanted)).select(*MESSAGE_COLUMNS).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def latest_per_subject(messages: DataFrame, wanted: MessageFilter) -> DataFrame:
    """The newest matching message of every subject, newest first; rows without a subject don't count.

    Filters come before the ranking: it is the latest among the matching.
    """
    rows = messages.where(condition(wanted) & F.col("subject_id").isNotNull() & (F.col("subject_id") != ""))
    rank = F.row_number().over(W.partitionBy("subject_id").orderBy(F.desc("created_at"), F.desc("id")))
    out = rows.select(*MESSAGE_COLUMNS, rank.alias("_rank")).where("_rank = 1").drop("_rank").orderBy(F.desc("created_at"), F.desc("id"))
    return out.limit(wanted.limit) if 0 < wanted.limit <= MOST_ROWS else out


def list_tasks(messages: DataFrame, status: str = "", limit: int = 0, type_name: str = "task", filter_first: bool = False) -> DataFrame:
    """Current state of every task.  The limit holds before the status filter unless ``filter_first``."""
    if status and status not in TASK_STATUSES and type_name == "task":
        raise InvalidArgument(f"status {status!r} is none of {', '.join(TASK_STATUSES)}")
    if limit < 0 or limit > 500:
        raise InvalidArgument("limit must be from 1 to 500")
    wanted = MessageFilter(type=type_name, limit=0 if filter_first else limit)
    out = latest_per_subject(messages, wanted)
    if status:
        out = out.where(F.get_json_object("content", "$.status") == status)
    return out.limit(limit) if filter_first and limit else out


def list_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("id"))


def numbered_sessions(sessions: DataFrame) -> DataFrame:
    """Every session with its ``place`` in the listing, newest first; ranges are numbered side by side, none in one task alone."""
    order = [F.desc("created_at"), F.desc("id")]
    parts = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that counts and ranks see the same ranges
    ranged = sessions.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn("place", (F.col("_before") + F.col("_rank")).cast("long")).drop("_range", "_rank", "_before")


def get_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("id") == session_id).limit(1)


def count_active(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("status") == "active").agg(F.count("*").alias("n_active"))


def admit_sessions(sessions: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """Candidates in order of created_at and id, with ``admitted`` as long as the cap of active sessions lasts; a cap of 0 or less admits all."""
    if cap <= 0:
        return candidates.withColumn("admitted", F.lit(True))
    room = sessions.where(F.col("status") == "active").agg((F.lit(cap) - F.count("*")).alias("room"))
    # a top-k of at most ``cap`` rows, so ranking them in one task is bounded
    first = candidates.orderBy("created_at", "id").limit(cap).withColumn("rank", F.row_number().over(W.orderBy("created_at", "id")))
    taken = first.join(F.broadcast(room)).where("rank <= room").select("id")
    return candidates.join(taken.withColumn("admitted", F.lit(True)), "id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def with_status(sessions: DataFrame, session_id: str, status: str) -> DataFrame:
    return sessions.withColumn("status", F.when(F.col("id") == session_id, F.lit(status)).otherwise(F.col("status")))


def delete_cascade(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in ``gone`` (column id); unknown ids do nothing."""
    ids = gone.select("id").distinct()
    return sessions.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def orphans(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def with_session(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
