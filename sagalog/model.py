"""Row types, filters, error classes and error codes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

SESSIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
    ]
)
MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
    ]
)
MESSAGE_COLUMNS = MESSAGES.fieldNames()
#: Limits on request bodies, in bytes.
MAX_SESSION_BODY, MAX_MESSAGE_BODY = 4 * 1024, 10 * 1024 * 1024
#: A cap of 0 or less is no cap.
DEFAULT_SESSION_CAP = 100
#: What a Spark limit can hold.
MOST_ROWS = (1 << 31) - 1


class EngineError(Exception):
    code, status = "internal_error", 500


class FilterRequired(EngineError):
    code, status = "validation_failed", 400


class NotFound(EngineError):
    code, status = "not_found", 404


class SessionCapReached(EngineError):
    code, status = "session_cap_reached", 503


class SchemaNotStrict(EngineError):
    code, status = "schema_violation", 400


class DuplicateType(EngineError):
    code, status = "validation_failed", 400


class InvalidArgument(EngineError):
    code, status = "validation_failed", 400


class BadArguments(InvalidArgument):
    code = "schema_violation"


@dataclass(frozen=True)
class MessageFilter:
    """Conjunction of equalities; empty values are unset; limit 0 is no limit."""

    session_id: str = ""
    role: str = ""
    sender_id: str = ""
    type: str = ""
    subject_id: str = ""
    limit: int = 0

    @classmethod
    def from_params(cls, params: dict[str, str]) -> MessageFilter:
        """From query parameters; a limit that is no positive integer is ignored."""
        limit = params.get("limit", "")
        known = {f.name: params.get(f.name, "") for f in fields(cls) if f.name != "limit"}
        number = int(limit) if re.fullmatch(r"\+?[0-9]{1,19}", limit) else 0
        return cls(**known, limit=number if number < 1 << 63 else 0)

    @property
    def dimensions(self) -> dict[str, str]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "limit" and getattr(self, f.name)}


@dataclass
class Result:
    """Envelope of a tool call."""

    status: str = "ok"
    data: Any = None
    error: dict[str, Any] | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def failed(cls, e: Exception) -> Result:
        """Anything that is no error of this engine is an internal one."""
        return cls(status="error", error={"code": getattr(e, "code", "internal_error") if isinstance(e, EngineError) else "internal_error", "message": str(e) or type(e).__name__})
