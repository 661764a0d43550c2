"""Registries of message types and of named queries (tools)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Schema, parse_schema
from ..model import DuplicateType, InvalidArgument, NotFound, SchemaNotStrict

#: States and fields of a task, and the example schemas.
TASK_STATUSES = ("new", "in-progress", "done", "abandoned")
TASK_SCHEMA = json.dumps(
    {
        "type": "object",
        "additionalProperties": False,
        "required": ["title", "status"],
        "properties": {
            "title": {"type": "string"},
            "status": {"type": "string", "enum": list(TASK_STATUSES)},
            "priority": {"type": "integer", "minimum": 0, "maximum": 5},
            "assignee": {"type": "string"},
            "notes": {"type": "string"},
            "blocker": {"type": "string"},
        },
    }
)
EXAMPLE_SCHEMAS = {
    "task.completed": {"properties": {"task_id": {"type": "string"}, "outcome": {"type": "string"}, "summary": {"type": "string"}, "duration_s": {"type": "integer", "minimum": 0}}, "required": ["task_id", "outcome"]},
    "decision.recorded": {"properties": {"question": {"type": "string"}, "decision": {"type": "string"}, "rationale": {"type": "string"}, "tradeoffs": {"type": "array"}}, "required": ["question", "decision", "rationale"]},
    "note.user": {"properties": {"body": {"type": "string"}, "context": {"type": "string"}, "tags": {"type": "array"}}, "required": ["body"]},
}


@dataclass(frozen=True)
class MessageType:
    """A name, its schema and an optional hook: content column -> error message column, null if fine."""

    name: str
    schema: Schema
    on_ingest: Callable[[Column], Column] | None = None


def task_error(content: Column) -> Column:
    """The hook of the task type: a status that is none of the known ones, should the schema ever let it through."""
    status = F.get_json_object(content, "$.status")
    known = F.coalesce(status.isin(*TASK_STATUSES), F.lit(False))
    return F.when(~known, F.lit(f"task.status must be one of [{', '.join(TASK_STATUSES)}]"))


class TypeRegistry:
    def __init__(self, builtins: bool = True):
        self._types: dict[str, MessageType] = {}
        if builtins:
            self.register("task", TASK_SCHEMA, task_error)

    def register(self, name: str, schema: str | bytes, on_ingest: Callable[[Column], Column] | None = None) -> MessageType:
        if not name:
            raise InvalidArgument("message type needs a name")
        parsed = parse_schema(schema)
        if not parsed.strict:
            raise SchemaNotStrict(f'schema of message type "{name}" must set additionalProperties to false')
        if name in self._types:
            raise DuplicateType(f'message type "{name}" is already registered')
        self._types[name] = MessageType(name, parsed, on_ingest)
        return self._types[name]

    def names(self) -> list[str]:
        return sorted(self._types)

    def lookup(self, name: str) -> MessageType:
        if name not in self._types:
            raise NotFound(f'message type "{name}" is not registered')
        return self._types[name]

    def load_directory(self, folder: str | Path) -> list[str]:
        """Register every ``*.json`` of a folder under its stem, in name order."""
        paths = sorted(Path(folder).glob("*.json"))
        return [self.register(p.stem, p.read_bytes()).name for p in paths]


def seed_examples(folder: str | Path) -> list[str]:
    """Write the example schemas that are not there yet; returns the names written."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    wrote = []
    for name, doc in EXAMPLE_SCHEMAS.items():
        path = Path(folder) / f"{name}.json"
        if not path.exists():
            path.write_text(json.dumps({"type": "object", "additionalProperties": False} | doc, indent=2))
            wrote.append(name)
    return wrote


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    schema: Schema
    run: Callable[..., DataFrame]


class ToolRegistry:
    """Named queries with checked parameters."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def register(self, name: str, description: str, schema: str, run: Callable[..., DataFrame]) -> None:
        parsed = parse_schema(schema)
        if not parsed.strict:
            raise SchemaNotStrict(f'input schema of tool "{name}" must set additionalProperties to false')
        self._tools[name] = Tool(name, description, parsed, run)

    def names(self) -> list[str]:
        return sorted(self._tools)

    def call(self, spark: SparkSession, name: str, arguments: dict) -> DataFrame:
        """Check the arguments with the same rules as message contents, then plan the query."""
        from ..functions.rules import violation

        if name not in self._tools:
            raise NotFound(f'tool "{name}" is not registered')
        tool = self._tools[name]
        bad = spark.range(1).select(violation(F.lit(json.dumps(arguments)), tool.schema, name)["message"].alias("m")).first()["m"]
        if bad:
            raise InvalidArgument(bad)
        return tool.run(**arguments)


def _plain(uri: str) -> str:
    return uri.split("?", 1)[0].split("{", 1)[0]


def resource_matches(pattern: str, uri: str) -> bool:
    """Exact; a template by its base, with any query; anything else with a query or fragment behind it."""
    if uri == pattern:
        return True
    if "{" in pattern:
        return _plain(pattern) == _plain(uri)
    return uri.startswith((pattern + "?", pattern + "#"))


@dataclass(frozen=True)
class Resource:
    """A named view: ``read`` gets the whole URI, with its query, and returns rows or a JSON value."""

    pattern: str
    description: str
    read: Callable[[str], object]

    @property
    def name(self) -> str:
        base = _plain(self.pattern)
        return base.split("://", 1)[1] if "://" in base else base


class ResourceRegistry:
    def __init__(self):
        self._resources: dict[str, Resource] = {}

    def register(self, pattern: str, description: str, read: Callable[[str], object]) -> None:
        if not pattern:
            raise InvalidArgument("resource needs a URI")
        self._resources[pattern] = Resource(pattern, description, read)

    def listing(self) -> list[dict]:
        """What there is, in the order of the URIs."""
        return [{"uri": k, "name": r.name, "description": r.description, "mimeType": "application/json"} for k, r in sorted(self._resources.items())]

    def find(self, uri: str) -> Resource:
        """The resource of a URI; an exact pattern before any other, then in the order of the patterns."""
        if not uri:
            raise InvalidArgument("uri is required")
        found = self._resources.get(uri) or next((r for k, r in sorted(self._resources.items()) if resource_matches(k, uri)), None)
        if found is None:
            raise NotFound(f"resource not found: {uri}")
        return found
