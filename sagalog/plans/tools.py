"""The query surface: eleven tools over a message store and PDF files, with checked arguments and an error vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textclean
from ..functions.geometry import TOLERANCE
from ..functions.rules import VIOLATION, Schema, parse_schema, violation
from ..model import MAX_MESSAGE_BODY, BadArguments, EngineError, InvalidArgument, MessageFilter, NotFound, Result, SchemaNotStrict
from ..operators.captions import link_images
from ..sources.manifest import read_manifest, write_manifest
from ..sources.pdfs import image_manifest, pdf_files, pdf_images, pdf_pages, stitched_images
from ..sources.store import MessageStore
from .registry import TASK_STATUSES, ResourceRegistry

#: Separators between pages: of the tool, of the command line, of the plain library call.
TOOL_BREAK, FILE_BREAK, PLAIN_BREAK = "\f", "\n\f\n", "\n"
_TEXT, _COUNT, _FLAG = {"type": "string"}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
_DIMENSIONS = {k: _TEXT for k in ("session_id", "role", "sender_id", "type", "subject_id")}
#: Tools and their parameters.
SCHEMAS: dict[str, tuple[dict, list[str]]] = {
    "create_session": ({"target": _TEXT, "metadata": _TEXT}, ["target"]),
    "deposit_message": (_DIMENSIONS | {"content": {"type": "object"}, "metadata": _TEXT}, ["session_id", "role", "type", "content"]),
    "get_latest_message": (_DIMENSIONS, []),
    "get_messages": (_DIMENSIONS | {"limit": _COUNT}, []),
    "get_session": ({"id": _TEXT}, ["id"]),
    "list_sessions": ({}, []),
    "list_tasks": ({"status": {"type": "string", "enum": list(TASK_STATUSES)}, "limit": {"type": "integer", "minimum": 1, "maximum": 500}}, []),
    "pdf_clean_text": ({"text": _TEXT, "manifest_path": _TEXT, "imgdir": _TEXT}, ["text"]),
    "pdf_extract_images": ({"path": _TEXT, "out_dir": _TEXT, "page": _COUNT, "pages": _TEXT, "stitch": _FLAG, "stitch_tol": {"type": "number", "minimum": 0}}, ["path", "out_dir"]),
    "pdf_extract_pages": ({"path": _TEXT}, ["path"]),
    "pdf_extract_text": ({"path": _TEXT, "page": _COUNT, "pages": _TEXT}, ["path"]),
}


def rows_json(df: DataFrame, limit: int = 100_000) -> list[dict]:
    """The rows of a result as dictionaries without null fields; a result with no rows is an empty list.

    This is the edge of the engine: a caller that asks for JSON gets it on the driver, so it is bounded.
    """
    found = df.limit(limit + 1).select(F.to_json(F.struct("*")).alias("j")).collect()
    if len(found) > limit:
        raise InvalidArgument(f"more than {limit} rows; set a limit or use the DataFrame")
    return [json.loads(r["j"]) for r in found]


class Engine:
    """Named tools over one store.  ``call`` never raises for a bad request; it returns the envelope."""

    def __init__(self, spark: SparkSession, store: MessageStore):
        self.spark, self.store = spark, store
        self._tools: dict[str, tuple[Schema, Callable[..., object]]] = {}
        self.resources = ResourceRegistry()
        for name, (properties, required) in SCHEMAS.items():
            self.register(name, json.dumps({"type": "object", "additionalProperties": False, "properties": properties, "required": required}), getattr(self, name))

    def register(self, name: str, schema: str, run: Callable[..., object]) -> None:
        parsed = parse_schema(schema)
        if not parsed.strict:
            raise SchemaNotStrict(f'input schema of tool "{name}" must set additionalProperties to false')
        self._tools[name] = (parsed, run)

    def tool_names(self) -> list[str]:
        return sorted(self._tools)

    def call(self, name: str, arguments: dict | None = None) -> Result:
        if name not in self._tools:
            return Result.failed(NotFound(f'tool "{name}" is not registered'))
        try:
            return self._call(name, arguments)
        except Exception as e:  # the envelope is the only way an error leaves
            return Result.failed(e)

    def read_resource(self, uri: str) -> Result:
        """The envelope of a resource; it gets the whole URI."""
        try:
            out = self.resources.find(uri).read(uri)
            return Result(data=rows_json(out) if isinstance(out, DataFrame) else out)
        except Exception as e:
            return Result.failed(e)

    def _call(self, name: str, arguments: dict | None) -> Result:
        schema, run = self._tools[name]
        bad = self.spark.range(1).select(violation(F.lit(json.dumps(arguments or {})), schema, name).cast(VIOLATION).alias("v")).first()["v"]
        if bad is not None:
            return Result(status="error", error={"code": "schema_violation", "message": bad["message"], "details": {k: v for k, v in bad.asDict().items() if k != "message" and v is not None}})
        out = run(**(arguments or {}))
        data = rows_json(out) if isinstance(out, DataFrame) else out
        return Result(data=data, metadata={"count": len(data)} if isinstance(data, list) else {})

    # --- the log ---

    def create_session(self, target: str, metadata: str = "") -> dict:
        text_only("target", target)
        text_only("metadata", metadata)
        ident = self.store.create_session(target, metadata or None)
        return rows_json(self.store.sessions.where(F.col("id") == ident))[0]

    def get_session(self, id: str) -> dict:
        self.store.get_session(id)
        return rows_json(self.store.sessions.where(F.col("id") == id))[0]

    def list_sessions(self) -> DataFrame:
        return self.store.list_sessions()

    def deposit_message(self, session_id: str, role: str, type: str, content, sender_id: str = "", subject_id: str = "", metadata: str = "") -> dict:
        text = content if isinstance(content, str) else json.dumps(content)
        for what, value in (("session_id", session_id), ("role", role), ("type", type), ("sender_id", sender_id), ("subject_id", subject_id), ("metadata", metadata)):
            text_only(what, value)
        if len(text.encode()) > MAX_MESSAGE_BODY:
            raise InvalidArgument(f"content is larger than {MAX_MESSAGE_BODY} bytes")
        row = [(session_id, role, type, text, sender_id, subject_id, metadata)]
        rejected, accepted = self.store.deposit_batch(self.spark.createDataFrame(row, "session_id string, role string, type string, content string, sender_id string, subject_id string, metadata string"))
        if rejected is not None:
            raise InvalidArgument(rejected.first()["error"])
        return rows_json(accepted)[0]

    def get_messages(self, limit: int = 0, **dimensions: str) -> DataFrame:
        return self.store.get_messages(MessageFilter(**dimensions, limit=limit))

    def get_latest_message(self, raw: bool = False, **dimensions: str):
        found = self.store.latest_message(MessageFilter(**dimensions))
        rows = rows_json(found)
        if not rows:
            raise NotFound("no message matches the filter")
        # only a query inside one session may ask for the bare content
        return json.loads(rows[0]["content"]) if raw and dimensions.get("session_id") else rows[0]

    def list_tasks(self, status: str = "", limit: int = 0) -> DataFrame:
        return self.store.list_tasks(status, limit)

    # --- documents ---

    def _pages(self, path: str) -> DataFrame:
        pages = pdf_pages(pdf_files(self.spark, path))
        broken = pages.where("error is not null").first()
        if broken is not None:
            raise EngineError(f"{broken['path']}: {broken['error']}")
        return pages

    def pdf_extract_text(self, path: str, page: int = 0, pages: str = "", between: str = TOOL_BREAK) -> dict:
        one_range(page, pages)
        found = self._pages(path)
        total = found.count()
        first, last = textclean.page_range(page, pages) or (1, max(total, 1))
        if last > total:
            raise BadArguments(f"page range {first}-{last} is out of bounds (document has {total} pages)")
        own = found.where(F.col("page").between(first, last)).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
        text = own.select(F.array_join(F.transform("p", lambda x: x["text"]), between).alias("t")).first()["t"]
        return {"text": text, "page_count": total}

    def pdf_extract_pages(self, path: str) -> DataFrame:
        return self._pages(path).select("page", "text").orderBy("page")

    def pdf_extract_images(self, path: str, out_dir: str, page: int = 0, pages: str = "", stitch: bool = True, stitch_tol: float = TOLERANCE) -> list[dict]:
        """Write the images and their manifest; the manifest comes back, never bytes."""
        one_range(page, pages)
        found = pdf_images(pdf_files(self.spark, path)).persist()
        try:
            return self._images(found, out_dir, textclean.page_range(page, pages), stitch, stitch_tol)
        finally:
            found.unpersist()

    def _images(self, found: DataFrame, out_dir: str, wanted: tuple[int, int] | None, stitch: bool, stitch_tol: float) -> list[dict]:
        # a file that can't be read has an error without a page; an image that was skipped has one
        broken = found.where("error is not null and page is null").first()
        if broken is not None:
            raise EngineError(f"{broken['path']}: {broken['error']}")
        found = found.where("error is null")
        if wanted:
            found = found.where(F.col("page").between(*wanted))
        found = (stitched_images(found, stitch_tol) if stitch else found).persist()
        try:
            lines = image_manifest(found)
            named = found.join(lines.select("path", "ord", "file"), ["path", "ord"])
            named.select("file", "data").foreachPartition(_writer(out_dir))
            write_manifest(lines, out_dir.rstrip("/") + "/manifest.tsv")
            return rows_json(lines.orderBy("page", "ord").drop("path", "ord"))
        finally:
            found.unpersist()

    def pdf_clean_text(self, text: str, manifest_path: str = "", imgdir: str = "") -> dict:
        if bool(manifest_path) != bool(imgdir):
            raise InvalidArgument("manifest_path and imgdir must be given together")
        docs = self.spark.createDataFrame([(0, text)], "doc int, raw string").select("doc", textclean.clean(F.col("raw")).alias("text"))
        if manifest_path:
            docs = link_images(docs, "doc", read_manifest(self.spark, manifest_path).withColumn("doc", F.lit(0)), imgdir)
        return {"markdown": docs.first()["text"]}


def text_only(what: str, value) -> None:
    if not isinstance(value, str):
        raise InvalidArgument(f"{what} must be a string")


def one_range(page: int, pages: str) -> None:
    if page and pages:
        raise BadArguments("page and pages are mutually exclusive")


def _writer(folder: str):
    def write(rows) -> None:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(path, recursive=True)
        for row in rows:
            with files.open_output_stream(f"{path}/{row['file']}") as out:
                out.write(bytes(row["data"]))

    return write
