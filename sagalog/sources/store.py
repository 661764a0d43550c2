"""The message store: Parquet segments and one pointer file that names those in force.

Appends add a segment; status changes and deletes write a new segment and leave
out the old ones.  Every commit is one atomic rename of the pointer; ``snapshot``
gives sessions and messages of the same moment.  Small segments are merged
sixteen at a time into one of the next tier, so a store of single deposits
keeps few segments.  One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DEFAULT_SESSION_CAP, MAX_SESSION_BODY, MESSAGES, SESSIONS, EngineError, InvalidArgument, MessageFilter, NotFound, SessionCapReached
from ..operators import log
from ..operators.ingest import checked
from ..plans.registry import TypeRegistry

VERSION = 2
#: Segments of one tier that are merged into one of the next.
MERGE = 16


class MessageStore:
    def __init__(self, spark: SparkSession, path: str, types: TypeRegistry | None = None, roles: list[str] | None = None, session_cap: int = DEFAULT_SESSION_CAP):
        self.spark, self.path = spark, path.rstrip("/")
        self.types, self.roles, self.session_cap = types or TypeRegistry(), roles or [], session_cap
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(self.path))
        if not self._files.exists(self._path(f"{self.path}/CURRENT")):
            self._commit({"version": VERSION, "sessions": [], "messages": []})
        self._migrate()

    # --- pointer and segments ---

    def _state(self) -> dict:
        stream = self._files.open(self._path(f"{self.path}/CURRENT"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        fresh = self._path(f"{self.path}/CURRENT.{uuid.uuid4().hex}")
        out = self._files.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark.sparkContext
        jvm = context._jvm
        options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), context._jsc.hadoopConfiguration()).rename(fresh, self._path(f"{self.path}/CURRENT"), options)

    def _segment(self, table: str, rows: DataFrame, tier: int = 0) -> str:
        name = f"{table}/t{tier}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _merged(self, state: dict, table: str, schema) -> dict:
        """``state`` with every MERGE segments of a tier as one of the next; each row is rewritten once a tier."""
        names, tier = list(state[table]), 0
        of = lambda n: int(n.split("/t", 1)[1].split("-", 1)[0]) if "/t" in n else 0
        while any(of(n) >= tier for n in names):
            own = [n for n in names if of(n) == tier]
            if len(own) >= MERGE:
                rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in own])
                names = [n for n in names if n not in own] + [self._segment(table, rows, tier + 1)]
            tier += 1
        return state | {table: names}

    def vacuum(self) -> int:
        """Delete the segments that the pointer no longer names; only while nothing reads an older state."""
        state, gone = self._state(), 0
        for table in ("sessions", "messages", "judged"):
            folder = self._path(f"{self.path}/{table}")
            for found in self._files.listStatus(folder) if self._files.exists(folder) else ():
                if f"{table}/{found.getPath().getName()}" not in state.get(table, ()):
                    gone += bool(self._files.delete(found.getPath(), True))
        return gone

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """(sessions, messages) of one moment."""
        state = self._state()
        return self._table("sessions", SESSIONS, state), self._table("messages", MESSAGES, state)

    def _table(self, table: str, schema, state: dict | None = None) -> DataFrame:
        names = (state or self._state())[table]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _migrate(self) -> None:
        """Forward only; a store newer than this code is refused; the old pointer is kept as a backup."""
        state = self._state()
        if state["version"] > VERSION:
            raise EngineError(f"store has version {state['version']}, this code knows {VERSION}")
        while state["version"] < VERSION:
            backup = self._files.create(self._path(f"{self.path}/CURRENT.v{state['version']}"), True)
            backup.write(bytearray(json.dumps(state).encode()))
            backup.close()
            # added columns read as null from older segments
            state = state | {"version": state["version"] + 1}
            self._commit(state)

    # --- tables ---

    @property
    def sessions(self) -> DataFrame:
        return self._table("sessions", SESSIONS)

    @property
    def messages(self) -> DataFrame:
        return self._table("messages", MESSAGES)

    def version(self) -> int:
        return self._state()["version"]

    # --- sessions ---

    def create_session(self, target: str, metadata: str | None = None) -> str:
        if not target:
            raise InvalidArgument("target must not be empty")
        if len(target.encode()) + len((metadata or "").encode()) > MAX_SESSION_BODY:
            raise InvalidArgument(f"session is larger than {MAX_SESSION_BODY} bytes")
        if self.session_cap > 0 and log.count_active(self.sessions).first()[0] >= self.session_cap:
            raise SessionCapReached(f"there are {self.session_cap} active sessions already")
        ident = str(uuid.uuid4())
        row = self.spark.range(1).select(F.lit(ident).alias("id"), F.lit(target).alias("target"), F.lit("active").alias("status"), F.current_timestamp().alias("created_at"), F.lit(metadata or None).cast("string").alias("metadata"))
        state = self._state()
        self._commit(self._merged(state | {"sessions": [*state["sessions"], self._segment("sessions", row)]}, "sessions", SESSIONS))
        return ident

    def get_session(self, ident: str):
        row = log.get_session(self.sessions, ident).first()
        if row is None:
            raise NotFound(f"session {ident} does not exist")
        return row

    def list_sessions(self) -> DataFrame:
        return log.list_sessions(self.sessions)

    def set_status(self, ident: str, status: str) -> None:
        self.get_session(ident)
        self._commit(self._state() | {"sessions": [self._segment("sessions", log.with_status(self.sessions, ident, status))]})

    def delete_session(self, ident: str) -> None:
        """Session and its messages; an unknown id is no error."""
        gone = self.spark.createDataFrame([(ident,)], "id string")
        sessions, messages = log.delete_cascade(*self.snapshot(), gone)
        self._commit(self._state() | {"sessions": [self._segment("sessions", sessions.select(*SESSIONS.fieldNames()))], "messages": [self._segment("messages", messages.select(*MESSAGES.fieldNames()))]})

    # --- messages ---

    def deposit(self, batch: DataFrame) -> DataFrame:
        """Validate a batch (session_id, role, type, content and optional columns); append what is accepted.

        Returns the rejected rows with their ``error``.  Ids go up by one from row to row.
        """
        rejected, _ = self.deposit_batch(batch)
        return rejected if rejected is not None else self.spark.createDataFrame([], batch.schema).withColumn("error", F.lit(""))

    def deposit_batch(self, batch: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(rejected rows with their error, None if there are none; the messages as they were appended)."""
        for name in ("sender_id", "subject_id", "metadata"):
            if name not in batch.columns:
                batch = batch.withColumn(name, F.lit(None).cast("string"))
        if "created_at" not in batch.columns:
            batch = batch.withColumn("created_at", F.current_timestamp())
        sessions, messages = self.snapshot()
        judged = checked(batch, sessions, self.types, self.roles)
        name = f"judged/{uuid.uuid4().hex}"
        judged.write.parquet(f"{self.path}/{name}")  # judged once, so that accepted and rejected rows agree
        judged = self.spark.read.schema(judged.schema).parquet(f"{self.path}/{name}")
        last = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
        # dense ids: the rows of the partitions before, then the place in the own one; one row a partition is broadcast
        placed = judged.where("error is null").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
        sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
        before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        ids = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(last + 1)
        accepted = placed.join(F.broadcast(before), "_part").withColumn("id", ids).select(*MESSAGES.fieldNames())
        state, segment = self._state(), self._segment("messages", accepted)
        appended = self.spark.read.schema(MESSAGES).parquet(f"{self.path}/{segment}")
        self._commit(self._merged(state | {"messages": [*state["messages"], segment]}, "messages", MESSAGES))
        rejected = judged.where("error is not null")
        if rejected.take(1):
            return rejected, appended
        self._files.delete(self._path(f"{self.path}/{name}"), True)
        return None, appended

    def get_messages(self, wanted: MessageFilter) -> DataFrame:
        return log.get_messages(self.messages, wanted)

    def latest_message(self, wanted: MessageFilter) -> DataFrame:
        return log.latest_message(self.messages, wanted)

    def latest_per_subject(self, wanted: MessageFilter) -> DataFrame:
        return log.latest_per_subject(self.messages, wanted)

    def list_tasks(self, status: str = "", limit: int = 0) -> DataFrame:
        return log.list_tasks(self.messages, status, limit)

    def raw_contents(self, found: DataFrame) -> str | None:
        """The content itself where exactly one message was found."""
        rows = found.select("content").limit(2).collect()
        return rows[0][0] if len(rows) == 1 else None
