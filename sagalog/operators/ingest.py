"""Batch deposit: validation as columns, referential check as a join, first error wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import violation
from ..model import MAX_MESSAGE_BODY
from ..plans.registry import TypeRegistry


def role_error(roles: list[str]) -> Column:
    """An empty list of roles accepts every role."""
    if not roles:
        return F.lit(None).cast("string")
    known = ", ".join(sorted(roles))
    return F.when(~F.coalesce(F.col("role").isin(roles), F.lit(False)), F.concat(F.lit('role "'), F.coalesce("role", F.lit("")), F.lit(f'" is not allowed. Allowed roles: [{known}]')))


def type_error(types: TypeRegistry) -> Column:
    names = types.names()
    return F.when(~F.coalesce(F.col("type").isin(names), F.lit(False)), F.concat(F.lit('message type "'), F.coalesce("type", F.lit("")), F.lit(f'" is not registered. Registered types: [{", ".join(names)}]')))


def content_error(types: TypeRegistry) -> Column:
    out = F.lit(None).cast("string")
    for name in types.names():
        out = F.when(F.col("type") == name, violation(F.col("content"), types.lookup(name).schema, name)["message"]).otherwise(out)
    return out


def hook_error(types: TypeRegistry) -> Column:
    out = F.lit(None).cast("string")
    for name in types.names():
        hook = types.lookup(name).on_ingest
        if hook is not None:
            out = F.when(F.col("type") == name, hook(F.col("content"))).otherwise(out)
    return out


def size_error(content: Column, most: int = MAX_MESSAGE_BODY) -> Column:
    return F.when(F.octet_length(content) > most, F.lit(f"content is larger than {most} bytes"))


def checked(batch: DataFrame, sessions: DataFrame, types: TypeRegistry, roles: list[str] | None = None) -> DataFrame:
    """``batch`` with ``error``: size, role, type, schema, hook, then unknown session; null for rows to accept.

    Empty sender, subject and metadata become null.  A batch of any size is
    one projection and one join.
    """
    for name in ("sender_id", "subject_id", "metadata"):
        if name in batch.columns:
            batch = batch.withColumn(name, F.nullif(F.col(name), F.lit("")))
    known = sessions.select(F.col("id").alias("session_id")).distinct().withColumn("_known", F.lit(True))
    out = batch.join(known, "session_id", "left")
    unknown = F.when(F.col("_known").isNull(), F.concat(F.lit("session "), F.coalesce("session_id", F.lit("")), F.lit(" does not exist")))
    return out.withColumn("error", F.coalesce(size_error(F.col("content")), role_error(roles or []), type_error(types), content_error(types), hook_error(types), unknown)).drop("_known")
