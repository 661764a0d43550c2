"""Streaming ingest of messages and the continuously kept latest state of every subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import checked
from ..plans.registry import TypeRegistry


def validated_sink(stream: DataFrame, sessions: DataFrame, types: TypeRegistry, accepted: str, rejected: str, checkpoint: str, roles: list[str] | None = None):
    """Split a message stream into two Parquet folders.

    A micro-batch goes to the folder of its number, overwritten when the batch
    is run again, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = checked(batch, sessions, types, roles).persist()
        judged.where("error is null").drop("error").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        judged.where("error is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        judged.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(stream: DataFrame, columns: list[str]) -> DataFrame:
    """One row per subject, the newest by (created_at, id); late rows change nothing that is newer."""
    rows = stream.where("subject_id is not null and subject_id != ''")
    newest = F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("m")
    return rows.groupBy("subject_id").agg(newest).select("m.*")
