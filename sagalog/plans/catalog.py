"""The registered queries of the engine, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, rules, textclean
from ..model import MessageFilter
from ..operators import captions, figures, ingest, log
from . import views as V
from .registry import EXAMPLE_SCHEMAS, TASK_SCHEMA, TypeRegistry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_COLUMNS = "id, session_id, role, sender_id, type, subject_id, content"
_STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at"


def query(sql: str | None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "session_id", "role", "sender_id", "type", "subject_id", "content", V.stamp("created_at").alias("created_at"))


def _messages(where: str, order: str = "", limit: int = 0) -> str:
    tail = (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")
    return f"SELECT {_COLUMNS}, {_STAMP} FROM (SELECT * FROM ({V.MESSAGES_SQL}) m WHERE {where}{tail}) x"


def _latest(view: str, where: str, limit: int = 0) -> str:
    tail = f" ORDER BY created_at DESC, id DESC LIMIT {limit}" if limit else ""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY created_at DESC, id DESC) AS rn
        FROM ({view}) m WHERE {where} AND subject_id IS NOT NULL AND subject_id <> '') r WHERE rn = 1{tail}"""


# --- reads of the log ---------------------------------------------------------


@query(f"SELECT {_COLUMNS}, {_STAMP} FROM ({_latest(V.MESSAGES_SQL, chr(39).join(['type = ', 'purchase', '']))}) x")
def latest_per_subject(spark, sf_dir):
    return _shown(log.latest_per_subject(V.messages(spark, sf_dir), MessageFilter(type="purchase")))


@query(f"SELECT {_COLUMNS}, {_STAMP} FROM ({_latest(V.MESSAGES_SQL, chr(39).join(['role = ', 'agent', '']), 25)}) x")
def latest_per_subject_limited(spark, sf_dir):
    """The newest 25 subjects: the limit is the feature."""
    return _shown(log.latest_per_subject(V.messages(spark, sf_dir), MessageFilter(role="agent", limit=25)))


@query(f"""SELECT arg_max(id, (created_at, id)) AS id, subject_id, count(*) AS n_messages FROM ({V.MESSAGES_SQL}) m
    WHERE subject_id IS NOT NULL AND subject_id <> '' GROUP BY subject_id""")
def latest_per_subject_by_aggregate(spark, sf_dir):
    """The same choice as a combinable aggregate, the form that streams."""
    m = V.messages(spark, sf_dir).where("subject_id is not null and subject_id != ''")
    return m.groupBy("subject_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("n_messages")).select("id", "subject_id", "n_messages")


@query(f"SELECT {_COLUMNS}, {_STAMP} FROM ({_latest(V.TASKS_SQL, chr(39).join(['type = ', 'task', '']))}) x")
def list_tasks(spark, sf_dir):
    return _shown(log.list_tasks(V.tasks(spark, sf_dir)))


@query(f"SELECT {_COLUMNS}, {_STAMP} FROM ({_latest(V.TASKS_SQL, chr(39).join(['type = ', 'task', '']), 60)}) x WHERE json_extract_string(content, '$.status') = 'done'")
def list_tasks_limited_status(spark, sf_dir):
    """Limit before status: fewer than the limit may come back."""
    return _shown(log.list_tasks(V.tasks(spark, sf_dir), status="done", limit=60))


@query(f"SELECT {_COLUMNS}, {_STAMP} FROM (SELECT * FROM ({_latest(V.TASKS_SQL, chr(39).join(['type = ', 'task', '']))}) x WHERE json_extract_string(content, '$.status') = 'new' ORDER BY created_at DESC, id DESC LIMIT 10) y")
def list_tasks_status_first(spark, sf_dir):
    return _shown(log.list_tasks(V.tasks(spark, sf_dir), status="new", limit=10, filter_first=True))


@query(_messages("session_id = '8'"))
def get_messages_by_session(spark, sf_dir):
    return _shown(log.get_messages(V.messages(spark, sf_dir), MessageFilter(session_id="8")))


@query(_messages("role = 'agent' AND type = 'click'"))
def get_messages_by_role_type(spark, sf_dir):
    return _shown(log.get_messages(V.messages(spark, sf_dir), MessageFilter(role="agent", type="click")))


@query(_messages("sender_id = 'u7'"))
def get_messages_by_sender(spark, sf_dir):
    return _shown(log.get_messages(V.messages(spark, sf_dir), MessageFilter(sender_id="u7")))


@query(_messages("subject_id = '42'"))
def get_messages_by_subject_cross_session(spark, sf_dir):
    return _shown(log.get_messages(V.messages(spark, sf_dir), MessageFilter(subject_id="42")))


@query(_messages("type = 'signup'", "created_at, id", 20))
def get_messages_oldest_n(spark, sf_dir):
    return _shown(log.get_messages(V.messages(spark, sf_dir), MessageFilter(type="signup", limit=20)))


@query(_messages("session_id = '8'", "created_at DESC, id DESC", 1))
def get_latest_message_in_session(spark, sf_dir):
    return _shown(log.latest_message(V.messages(spark, sf_dir), MessageFilter(session_id="8")))


@query(_messages("type = 'error' AND role = 'orchestrator'", "created_at DESC, id DESC", 1))
def get_latest_message_cross_session(spark, sf_dir):
    return _shown(log.latest_message(V.messages(spark, sf_dir), MessageFilter(type="error", role="orchestrator")))


@query(f"SELECT id, target, status, {_STAMP}, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM ({V.SESSIONS_SQL}) s")
def list_sessions_newest_first(spark, sf_dir):
    return log.numbered_sessions(V.sessions(spark, sf_dir)).select("id", "target", "status", V.stamp("created_at").alias("created_at"), "place")


@query(f"SELECT id, target, status, {_STAMP}, metadata FROM ({V.SESSIONS_SQL}) s")
def list_sessions(spark, sf_dir):
    return log.list_sessions(V.sessions(spark, sf_dir)).select("id", "target", "status", V.stamp("created_at").alias("created_at"), "metadata")


@query(f"SELECT count(*) AS n_active FROM ({V.SESSIONS_SQL}) s WHERE status = 'active'")
def count_active_sessions(spark, sf_dir):
    return log.count_active(V.sessions(spark, sf_dir))


@query("SELECT coalesce(max(version), 0) AS version FROM (VALUES (1), (2)) AS v(version)")
def max_schema_version(spark, sf_dir):
    return spark.createDataFrame([(1,), (2,)], "version int").agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


@query(f"SELECT id, target, status, {_STAMP} FROM ({V.SESSIONS_SQL}) s WHERE id = '7'")
def get_session(spark, sf_dir):
    return log.get_session(V.sessions(spark, sf_dir), "7").select("id", "target", "status", V.stamp("created_at").alias("created_at"))


@query(f"""WITH s AS ({V.SESSIONS_SQL}), c AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS rk FROM s WHERE status = 'complete'),
    room AS (SELECT (SELECT count(*) FROM s WHERE status = 'active') + 100 - count(*) AS room FROM s WHERE status = 'active')
    SELECT c.id, coalesce(rk <= room, false) AS admitted FROM c, room""")
def active_session_cap_admission(spark, sf_dir):
    """The cap leaves room for a hundred more than are active."""
    s = V.sessions(spark, sf_dir)
    active = s.where("status = 'active'")
    return log.admit_sessions(active, s.where("status = 'complete'"), active.count() + 100).select("id", "admitted")


# --- referential integrity ----------------------------------------------------

_KNOWN = f"SELECT id FROM ({V.SESSIONS_SQL}) s WHERE status <> 'failed'"


def _line_messages(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), "l_linenumber", "l_quantity")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS session_id, count(*) AS n_messages, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN ({_KNOWN}) GROUP BY 1")
def deposit_fk_valid(spark, sf_dir):
    known = V.sessions(spark, sf_dir).where("status != 'failed'")
    return log.with_session(_line_messages(spark, sf_dir), known).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.sum("l_quantity").alias("quantity"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS session_id, count(*) AS n_messages, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN ({_KNOWN}) GROUP BY 1")
def deposit_fk_orphans(spark, sf_dir):
    known = V.sessions(spark, sf_dir).where("status != 'failed'")
    return log.orphans(_line_messages(spark, sf_dir), known).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.sum("l_quantity").alias("quantity"))


@query(f"""WITH s AS ({V.SESSIONS_SQL}), k AS (SELECT id FROM s WHERE metadata <> '1-URGENT')
    SELECT 'sessions' AS tbl, count(*) AS n_rows FROM k UNION ALL
    SELECT 'messages', count(*) FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT id FROM k)""")
def delete_session_cascade(spark, sf_dir):
    s = V.sessions(spark, sf_dir)
    left, rest = log.delete_cascade(s, _line_messages(spark, sf_dir), s.where("metadata = '1-URGENT'"))
    return left.agg(F.count("*").alias("n_rows")).select(F.lit("sessions").alias("tbl"), "n_rows").unionByName(rest.agg(F.count("*").alias("n_rows")).select(F.lit("messages").alias("tbl"), "n_rows"))


# --- deposit checks -----------------------------------------------------------


@cache
def _types() -> TypeRegistry:
    return TypeRegistry()


@query("SELECT conv_id, turn, role IN ('user', 'assistant') AS accepted FROM conversations")
def deposit_role_check(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ingest.role_error(["user", "assistant"]).isNull().alias("accepted"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'message type \"note\" is not registered. Registered types: [task]' END AS error FROM conversations")
def deposit_type_check(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("turn") % 2 == 0, "task").otherwise("note"))
    return c.select("conv_id", "turn", ingest.type_error(_types()).alias("error"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'note' ELSE 'task' END AS type,
        CASE WHEN turn % 2 = 0 THEN '{"title":"a","status":"new"}' ELSE '{"title":"a"}' END AS content, conv_id % 4 <> 3 AS known FROM conversations)
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'role "system" is not allowed. Allowed roles: [assistant, user]'
        WHEN type = 'note' THEN 'message type "note" is not registered. Registered types: [task]'
        WHEN content = '{"title":"a"}' THEN 'required field "status" missing in input for task'
        WHEN NOT known THEN 'session ' || CAST(conv_id AS VARCHAR) || ' does not exist' END AS error FROM m""")
def deposit_error_precedence(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    batch = c.select(
        "conv_id", "turn", "role", F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("turn") % 3 == 2, "note").otherwise("task").alias("type"),
        F.when(F.col("turn") % 2 == 0, '{"title":"a","status":"new"}').otherwise('{"title":"a"}').alias("content"),
    )
    known = c.where("conv_id % 4 != 3").select(F.col("conv_id").cast("string").alias("id")).distinct()
    return ingest.checked(batch, known, _types(), ["user", "assistant"]).select("conv_id", "turn", "error")


# --- schema rules ---------------------------------------------------------------

_DOC = f"SELECT id, content, CASE WHEN content = 'null' THEN '{{}}' ELSE content END AS j FROM ({V.PAYLOADS_SQL}) p"
_VALID = ["assignee", "blocker", "notes", "priority", "status", "title"]
_VALID_SQL = ", ".join(f"'{v}'" for v in _VALID)
_OBJECT = "json_type(j) = 'OBJECT'"
_UNKNOWN_SQL = f"list_sort(list_filter(json_keys(j), lambda k: NOT list_contains([{_VALID_SQL}], k)))[1]"
_MISSING_SQL = "list_sort(list_filter(['status', 'title'], lambda k: NOT list_contains(json_keys(j), k)))[1]"


def _label(f: str) -> str:
    t = f"json_type(j, '$.{f}')"
    return f"CASE {t} WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def _text_field(f: str) -> str:
    return f"WHEN list_contains(json_keys(j), '{f}') AND {_label(f)} NOT IN ('string', 'null') THEN 'field \"{f}\" in input for task: expected string, got ' || {_label(f)}"


_MESSAGE_SQL = f"""CASE WHEN NOT {_OBJECT} THEN 'input for task must be a JSON object'
    WHEN {_UNKNOWN_SQL} IS NOT NULL THEN 'unknown field "' || {_UNKNOWN_SQL} || '" in input for task. Valid fields: [{", ".join(_VALID)}]'
    WHEN {_MISSING_SQL} IS NOT NULL THEN 'required field "' || {_MISSING_SQL} || '" missing in input for task'
    {_text_field("assignee")} {_text_field("blocker")} {_text_field("notes")}
    WHEN list_contains(json_keys(j), 'priority') AND {_label("priority")} = 'null' THEN 'field "priority" in input for task: expected integer, got  (null)'
    WHEN json_type(j, '$.priority') = 'DOUBLE' THEN 'field "priority" in input for task: expected integer, got ' || json_extract_string(j, '$.priority') || ' (number)'
    WHEN CAST(json_extract_string(j, '$.priority') AS DOUBLE) < 0 THEN 'field "priority" in input for task: value ' || json_extract_string(j, '$.priority') || ' is below minimum 0'
    WHEN CAST(json_extract_string(j, '$.priority') AS DOUBLE) > 5 THEN 'field "priority" in input for task: value ' || json_extract_string(j, '$.priority') || ' is above maximum 5'
    {_text_field("status")}
    WHEN json_extract_string(j, '$.status') NOT IN ('new', 'in-progress', 'done', 'abandoned') THEN 'field "status" in input for task: value "' || json_extract_string(j, '$.status') || '" not in enum [abandoned, done, in-progress, new]'
    {_text_field("title")} END"""


def _violations(spark, sf_dir) -> DataFrame:
    return V.payloads(spark, sf_dir).withColumn("v", rules.violation(F.col("content"), rules.parse_schema(TASK_SCHEMA), "task"))


@query(f"SELECT id, {_MESSAGE_SQL} AS message FROM ({_DOC}) d")
def schema_violation_message(spark, sf_dir):
    return _violations(spark, sf_dir).select("id", F.col("v.message").alias("message"))


@query(f"SELECT id, CASE WHEN {_OBJECT} THEN {_UNKNOWN_SQL} END AS unknown_field FROM ({_DOC}) d")
def schema_unknown_field(spark, sf_dir):
    only = rules.Schema(rules.parse_schema(TASK_SCHEMA).rules, (), True)
    v = rules.violation(F.col("content"), rules.Schema({k: rules.Rule() for k in only.rules}, (), True), "task")
    return V.payloads(spark, sf_dir).select("id", v["field"].alias("unknown_field"))


@query(f"SELECT id, CASE WHEN {_OBJECT} THEN {_MISSING_SQL} END AS missing_field FROM ({_DOC}) d")
def schema_required(spark, sf_dir):
    v = rules.violation(F.col("content"), rules.Schema({}, ("status", "title"), False), "task")
    return V.payloads(spark, sf_dir).select("id", v["field"].alias("missing_field"))


@query(f"""SELECT id, CASE WHEN {_OBJECT} AND list_contains(json_keys(j), 'title') AND {_label("title")} NOT IN ('string', 'null') THEN 'title'
    WHEN {_OBJECT} AND list_contains(json_keys(j), 'status') AND {_label("status")} NOT IN ('string', 'null') THEN 'status' END AS wrong_field FROM ({_DOC}) d""")
def schema_type(spark, sf_dir):
    text = rules.Rule("string")
    first = rules.violation(F.col("content"), rules.Schema({"title": text}), "task")["field"]
    second = rules.violation(F.col("content"), rules.Schema({"status": text}), "task")["field"]
    return V.payloads(spark, sf_dir).select("id", F.coalesce(first, second).alias("wrong_field"))


@query(f"SELECT id, coalesce({_OBJECT} AND json_type(j, '$.status') = 'VARCHAR' AND json_extract_string(j, '$.status') NOT IN ('done', 'new'), false) AS not_in_enum FROM ({_DOC}) d")
def schema_enum(spark, sf_dir):
    v = rules.violation(F.col("content"), rules.Schema({"status": rules.Rule("string", enum=("new", "done"))}), "task")
    return V.payloads(spark, sf_dir).select("id", F.coalesce(v["field"] == "status", F.lit(False)).alias("not_in_enum"))


@query(f"SELECT id, CASE WHEN {_OBJECT} AND (CAST(json_extract_string(j, '$.priority') AS DOUBLE) < 0 OR CAST(json_extract_string(j, '$.priority') AS DOUBLE) > 5) THEN CAST(json_extract_string(j, '$.priority') AS DOUBLE) END AS out_of_bounds FROM ({_DOC}) d")
def schema_bounds(spark, sf_dir):
    v = rules.violation(F.col("content"), rules.Schema({"priority": rules.Rule("number", 0.0, 5.0)}), "task")
    value = F.get_json_object("content", "$.priority").try_cast("double")
    return V.payloads(spark, sf_dir).select("id", F.when(v["message"].contains("imum"), value).alias("out_of_bounds"))


@query("SELECT * FROM (VALUES ('decision.recorded'), ('note.user'), ('task'), ('task.completed')) AS t(name)")
def registered_types_sorted(spark, sf_dir):
    import json

    types = TypeRegistry()
    for name, doc in EXAMPLE_SCHEMAS.items():
        types.register(name, json.dumps({"additionalProperties": False} | doc))
    return spark.createDataFrame([(n,) for n in types.names()], "name string")


@query("SELECT * FROM (VALUES ('create_session'), ('deposit_message'), ('get_latest_message'), ('get_messages'), ('get_session'), ('list_sessions'), ('list_tasks'), ('pdf_clean_text'), ('pdf_extract_images'), ('pdf_extract_pages'), ('pdf_extract_text')) AS t(name)")
def tool_registry_sorted(spark, sf_dir):
    from .tools import SCHEMAS

    return spark.createDataFrame([(n,) for n in sorted(SCHEMAS)], "name string")


@query(f"SELECT id, target, CASE WHEN id = '7' THEN 'paused' ELSE status END AS status FROM ({V.SESSIONS_SQL}) s")
def update_session_status(spark, sf_dir):
    return log.with_status(V.sessions(spark, sf_dir), "7", "paused").select("id", "target", "status")


@query("SELECT conv_id, turn, strlen(text) > 600 AS too_large FROM conversations")
def deposit_body_cap(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ingest.size_error(F.col("text"), 600).isNotNull().alias("too_large"))


# --- text -----------------------------------------------------------------------

_W = r"[\p{L}\p{N}]"


def _re(expr: str, pattern: str, into: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{into}', 'g')"


#: The patterns of the text repairs, said once more for the oracle.
_REJOINED = "text"
for _p, _i in (
    (rf"({_W}+)\s*\n\s*-\s*\n\s*({_W}+)", r"\1-\2"),
    (rf"({_W}+)\s*\n\s*-\s*\n\s*({_W}+)", r"\1-\2"),
    (r"\[\s*\n+\s*(\d+)\s*\n+\s*\]", r"[\1]"),
    (r"(\d[\d,.]*)[ \t]*\n+[ \t]*–[ \t]*\n+[ \t]*(\d)", r"\1–\2"),
    (r"(\S)[ \t]*\n+[ \t]*–[ \t]*\n+[ \t]*(\S)", r"\1 – \2"),
):
    _REJOINED = _re(_REJOINED, _p, _i)
_PARTS = rf"regexp_split_to_array({_REJOINED}, '\n*\f\n*')"
_PAGED = f"array_to_string(list_transform({_PARTS}, lambda p, i: CASE WHEN i = 1 THEN p ELSE chr(10) || chr(10) || '<!-- page ' || CAST(i AS VARCHAR) || ' -->' || chr(10) || chr(10) || p END), '')"
_TRIMMED = _re(_re(_PAGED, r"\n{3,}", "{NN}"), r"^[\s\v\x85\p{Z}]+|[\s\v\x85\p{Z}]+\z", "").replace("'{NN}'", "chr(10) || chr(10)")


@query(f"SELECT doc_id, '<!-- page 1 -->' || chr(10) || chr(10) || {_TRIMMED} || chr(10) AS text FROM ({V.RAW_TEXT_SQL}) d")
def clean_text(spark, sf_dir):
    return V.raw_text(spark, sf_dir).select("doc_id", textclean.clean(F.col("text")).alias("text"))


@query(rf"""SELECT doc_id, i AS page, p[i] AS page_text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
    FROM (SELECT doc_id, regexp_split_to_array(text, '\n*\f\n*') AS p FROM ({V.RAW_TEXT_SQL}) d) x) y""")
def split_pages(spark, sf_dir):
    return captions.split_pages(V.raw_text(spark, sf_dir), "doc_id").select("doc_id", F.col("page").cast("long").alias("page"), "page_text")


@query(rf"""SELECT doc_id, string_agg(p[i], chr(10) || chr(12) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
    FROM (SELECT doc_id, regexp_split_to_array(text, '\n*\f\n*') AS p FROM ({V.RAW_TEXT_SQL}) d) x) y WHERE i BETWEEN 2 AND 3 GROUP BY doc_id""")
def page_range(spark, sf_dir):
    first, last = textclean.page_range(pages="2-3")
    return captions.join_page_range(captions.split_pages(V.raw_text(spark, sf_dir), "doc_id"), "doc_id", first, last)


_LINES = f"""SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({V.CAPTIONED_SQL}) d) x) y"""
_NUMBERED = rf"""SELECT doc_id, line_no, line, coalesce(last_value(TRY_CAST(nullif(regexp_extract(line, '^<!-- page (\d+) -->', 1), '') AS INTEGER) IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page FROM ({_LINES}) z"""
#: The caption labels, said once more for the oracle.
_E = r"(?:[.\s—–:]|$)"
_LABEL = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(line, '^({p}){_E}', 1), '')"
    for p in (r"Figure \d+-\d+", r"Рисунок \d+(?:\.\d+)?", r"Рис\. \d+(?:\.\d+)?", r"Мал\. \d+(?:\.\d+)?", r"Схема (?:№\s*)?\d+(?:\.\d+)?", r"Table \d+-\d+")
) + ")"
_CAPTIONS = f"SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k FROM (SELECT doc_id, line_no, page, line, {_LABEL} AS label FROM ({_NUMBERED}) n) c WHERE label IS NOT NULL"
_IMAGES = f"SELECT doc_id, page, file, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM ({V.MANIFEST_SQL}) m"


@query(f"SELECT doc_id, page, count(*) AS n_lines, min(line_no) AS first_line FROM ({_NUMBERED}) n GROUP BY doc_id, page")
def page_number_running(spark, sf_dir):
    lines = captions.numbered_lines(V.captioned(spark, sf_dir), "doc_id")
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"))


@query(f"SELECT doc_id, line_no, page, label FROM ({_CAPTIONS}) c")
def caption_match(spark, sf_dir):
    lines = captions.numbered_lines(V.captioned(spark, sf_dir), "doc_id").withColumn("label", textclean.caption_label(F.col("line")))
    return lines.where("label is not null").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "page", "label")


@query(f"SELECT c.doc_id, line_no, c.page, label, file FROM ({_CAPTIONS}) c LEFT JOIN ({_IMAGES}) i ON c.doc_id = i.doc_id AND c.page = i.page AND c.k = i.k")
def caption_image_link(spark, sf_dir):
    lines = captions.numbered_lines(V.captioned(spark, sf_dir), "doc_id")
    return captions.caption_links(lines, "doc_id", V.manifest(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "page", "label", "file")


@query(f"""SELECT n.doc_id, string_agg(CASE WHEN f.file IS NULL THEN '' ELSE '![' || f.label || '](images/atp/' || f.file || ')' || chr(10) || chr(10) END || n.line, chr(10) ORDER BY n.line_no) AS text
    FROM ({_NUMBERED}) n LEFT JOIN (SELECT c.doc_id, line_no, label, file FROM ({_CAPTIONS}) c JOIN ({_IMAGES}) i ON c.doc_id = i.doc_id AND c.page = i.page AND c.k = i.k) f
    ON n.doc_id = f.doc_id AND n.line_no = f.line_no GROUP BY n.doc_id""")
def link_images(spark, sf_dir):
    return captions.link_images(V.captioned(spark, sf_dir), "doc_id", V.manifest(spark, sf_dir), "images/./atp/")


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || CAST(page_id AS VARCHAR) || '.png' WHEN 1 THEN '/etc/' || CAST(page_id AS VARCHAR)
        WHEN 2 THEN 'sub/../../x.png' WHEN 3 THEN 'nested/../sub/' || CAST(page_id AS VARCHAR) || '.png' ELSE 'a/./b//c.png' END AS file FROM pages)
    SELECT page_id, file, file LIKE 'nested/%' OR file LIKE 'a/%' AS is_local FROM p""")
def manifest_local_path_guard(spark, sf_dir):
    n = F.col("page_id").cast("string")
    file = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), n, F.lit(".png"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/etc/"), n)).when(F.col("page_id") % 5 == 2, "sub/../../x.png").when(F.col("page_id") % 5 == 3, F.concat(F.lit("nested/../sub/"), n, F.lit(".png"))).otherwise("a/./b//c.png")
    return V.table(spark, sf_dir, "pages").select("page_id", file.alias("file")).withColumn("is_local", textclean.is_local_path(F.col("file")))


@query(r"""SELECT doc_id, trim(array_to_string(list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda x: rtrim(x)), chr(10)), chr(10)) AS text
    FROM (SELECT doc_id, chr(10) || replace(replace(text, '. ', '.  ' || chr(10)), ' of ', ' ' || chr(9) || ' of ') || ' ' || chr(10) AS text FROM documents) d""")
def normalise_page_lines(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".  \n")), F.lit(" of "), F.lit(" \t of "))
    return V.table(spark, sf_dir, "documents").select("doc_id", textclean.normalise_lines(F.concat(F.lit("\n"), t, F.lit(" \n"))).alias("text"))


# --- geometry -------------------------------------------------------------------


def _near(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= 2.0"


_VERTICAL = f"{_near('a.bbox_x', 'b.bbox_x')} AND {_near('(a.bbox_x + a.bbox_w)', '(b.bbox_x + b.bbox_w)')} AND ({_near('a.bbox_y', '(b.bbox_y + b.bbox_h)')} OR {_near('b.bbox_y', '(a.bbox_y + a.bbox_h)')})"
_HORIZONTAL = f"{_near('a.bbox_y', 'b.bbox_y')} AND {_near('(a.bbox_y + a.bbox_h)', '(b.bbox_y + b.bbox_h)')} AND ({_near('a.bbox_x', '(b.bbox_x + b.bbox_w)')} OR {_near('b.bbox_x', '(a.bbox_x + a.bbox_w)')})"
_PAIRS = f"""SELECT a.page, a.ord AS i, b.ord AS j, CASE WHEN {_VERTICAL} THEN 'vertical' WHEN {_HORIZONTAL} THEN 'horizontal' END AS layout
    FROM boxes a JOIN boxes b ON a.page = b.page AND a.ord < b.ord AND a.bbox_w <> 0 AND b.bbox_w <> 0"""
_GROUPED = f"""WITH RECURSIVE boxes AS MATERIALIZED ({V.PANELS_SQL}), pairs AS MATERIALIZED (SELECT * FROM ({_PAIRS}) p WHERE layout IS NOT NULL),
    sym AS (SELECT page, i, j FROM pairs UNION SELECT page, j, i FROM pairs),
    reach(page, ord, other) AS (SELECT page, ord, ord FROM boxes UNION SELECT r.page, r.ord, s.j FROM reach r JOIN sym s ON r.page = s.page AND r.other = s.i),
    grouped AS MATERIALIZED (SELECT b.*, g.group_id FROM boxes b JOIN (SELECT page, ord, min(other) AS group_id FROM reach GROUP BY page, ord) g ON b.page = g.page AND b.ord = g.ord)"""


@query(f"WITH boxes AS ({V.PANELS_SQL}) SELECT page, i, j, layout FROM ({_PAIRS}) p WHERE layout IS NOT NULL")
def panel_adjacency_pairs(spark, sf_dir):
    return figures.adjacent_pairs(V.panels(spark, sf_dir), ["page"])


@query(f"{_GROUPED} SELECT page, ord, group_id FROM grouped")
def figure_groups(spark, sf_dir):
    return figures.group_panels(V.panels(spark, sf_dir), ["page"]).select("page", "ord", "group_id")


_VOTES = "SELECT g.page, g.group_id, count(*) FILTER (layout = 'horizontal') AS h, count(*) FILTER (layout = 'vertical') AS v FROM pairs p JOIN grouped g ON p.page = g.page AND p.i = g.ord GROUP BY 1, 2"
_LAYOUT = f"SELECT g.page, g.group_id, CASE WHEN count(*) = 1 THEN '' WHEN max(h) > max(v) THEN 'horizontal' ELSE 'vertical' END AS layout, count(*) AS n_parts FROM grouped g LEFT JOIN ({_VOTES}) t ON g.page = t.page AND g.group_id = t.group_id GROUP BY 1, 2"


@query(f"{_GROUPED} SELECT page, group_id, layout, n_parts FROM ({_LAYOUT}) l")
def figure_layout(spark, sf_dir):
    return figures.figures(V.panels(spark, sf_dir), ["page"]).select("page", "group_id", "layout", "n_parts")


@query(f"{_GROUPED} SELECT page, group_id, min(bbox_x) AS bbox_x, min(bbox_y) AS bbox_y, max(bbox_x + bbox_w) - min(bbox_x) AS bbox_w, max(bbox_y + bbox_h) - min(bbox_y) AS bbox_h FROM grouped GROUP BY 1, 2")
def figure_bbox_union(spark, sf_dir):
    return figures.figures(V.panels(spark, sf_dir), ["page"]).select("page", "group_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h")


@query(f"""{_GROUPED}, lay AS ({_LAYOUT}) SELECT g.page, g.group_id, string_agg(name, '+' ORDER BY CASE WHEN layout = 'vertical' THEN -bbox_y WHEN layout = 'horizontal' THEN bbox_x ELSE 0 END, ord) AS stitched_name,
    CAST(CASE WHEN layout = 'horizontal' THEN sum(width) ELSE max(width) END AS BIGINT) AS width, CAST(CASE WHEN layout = 'horizontal' THEN max(height) ELSE sum(height) END AS BIGINT) AS height
    FROM grouped g JOIN lay l ON g.page = l.page AND g.group_id = l.group_id GROUP BY g.page, g.group_id, layout""")
def stitched_figures(spark, sf_dir):
    return figures.figures(V.panels(spark, sf_dir), ["page"]).select("page", "group_id", "stitched_name", "width", "height")


@query("""SELECT event_id, least(f, b + f, d + f, b + d + f) AS bbox_y, least(e, a + e, c + e, a + c + e) AS bbox_x,
        greatest(e, a + e, c + e, a + c + e) - least(e, a + e, c + e, a + c + e) AS bbox_w, greatest(f, b + f, d + f, b + d + f) - least(f, b + f, d + f, b + d + f) AS bbox_h
    FROM (SELECT event_id, value * 2.0e0 AS a, CAST(event_id % 3 AS DOUBLE) AS b, CAST(-(event_id % 2) AS DOUBLE) AS c, 100.0e0 AS d, CAST(user_id AS DOUBLE) + 5.0e0 AS e, 75.0e0 AS f FROM events) m""")
def affine_unit_bbox(spark, sf_dir):
    """Unit boxes of a map that is a product: scale and shear first, then a shift by (5, 0)."""
    e = V.table(spark, sf_dir, "events")
    one, zero = F.lit(1.0), F.lit(0.0)
    local = (F.col("value") * 2.0, (F.col("event_id") % 3).cast("double"), (-(F.col("event_id") % 2)).cast("double"), F.lit(100.0), F.col("user_id").cast("double"), F.lit(75.0))
    m = geometry.concat_affine(local, (one, zero, zero, one, F.lit(5.0), zero))
    return e.select("event_id", *[c.alias(k) for k, c in geometry.unit_box(m).items()])


@query("""SELECT event_id, CAST((255 - event_id % 256) * (255 - user_id % 200) // 255 AS INTEGER) AS r, CAST((255 - event_id * 7 % 256) * (255 - user_id % 200) // 255 AS INTEGER) AS g,
    CAST((255 - event_id * 13 % 256) * (255 - user_id % 200) // 255 AS INTEGER) AS b FROM events""")
def cmyk_to_rgb(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    c = geometry.cmyk_to_rgb(F.col("event_id") % 256, F.col("event_id") * 7 % 256, F.col("event_id") * 13 % 256, F.col("user_id") % 200)
    return e.select("event_id", *[v.alias(k) for k, v in c.items()])


# --- documents -------------------------------------------------------------------


def _sample_pdfs(spark, sf_dir) -> DataFrame:
    """One small PDF per customer, written from its lines: two pages of text, panels that touch."""
    from ..sources.samples import pdf_of

    # writing and parsing files is the work here, so the few rows are dealt to all cores
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(spark.sparkContext.defaultParallelism, "c_custkey")

    def write(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"path": [f"/customers/{k}.pdf" for k in pdf["c_custkey"]], "content": [pdf_of(int(k), str(t)) for k, t in zip(pdf["c_custkey"], pdf["c_mktsegment"], strict=True)]})

    return rows.mapInPandas(write, "path string, content binary")


@query("SELECT '/customers/' || CAST(c_custkey AS VARCHAR) || '.pdf' AS path, CAST(p AS INTEGER) AS page, CASE p WHEN 1 THEN 'Order ' || CAST(c_custkey AS VARCHAR) || chr(10) || 'priority ' || c_mktsegment ELSE 'Figure ' || CAST(c_custkey AS VARCHAR) || '-1. Panels' END AS text FROM customer, (VALUES (1), (2)) AS v(p)")
def pdf_pages(spark, sf_dir):
    from ..sources.pdfs import pdf_pages as read

    return read(_sample_pdfs(spark, sf_dir)).select("path", "page", "text")


@query("""SELECT '/customers/' || CAST(c_custkey AS VARCHAR) || '.pdf' AS path, 2 AS page, 'Im0+Im1' AS name, 4 AS width, 4 AS height, 'stitched' AS colorspace,
    10.0e0 AS bbox_x, 20.0e0 AS bbox_y, 100.0e0 AS bbox_w, 100.0e0 AS bbox_h FROM customer WHERE c_custkey % 10 = 0
    UNION ALL SELECT '/customers/' || CAST(c_custkey AS VARCHAR) || '.pdf', 2, n, 4, 2, 'DeviceGray', 10.0e0, CASE n WHEN 'Im0' THEN 70.0e0 ELSE 0.0e0 END, 100.0e0, 50.0e0
    FROM customer, (VALUES ('Im0'), ('Im1')) AS v(n) WHERE c_custkey % 10 <> 0""")
def pdf_images(spark, sf_dir):
    """Two panels a document; in every tenth they touch and are stitched."""
    from ..sources.pdfs import pdf_images as read
    from ..sources.pdfs import stitched_images

    found = stitched_images(read(_sample_pdfs(spark, sf_dir)))
    return found.select("path", "page", "name", "width", "height", "colorspace", "bbox_x", "bbox_y", "bbox_w", "bbox_h")


@query("""SELECT CAST(c_custkey AS VARCHAR) || '-p0002-' || n || '.png' AS file, 2 AS page, n AS name, 4 AS width, 2 AS height, 8 AS bpc, 'DeviceGray' AS colorspace, 'FlateDecode' AS filter,
    '10.00' AS bbox_x, CASE WHEN n = 'Im0' THEN '70.00' WHEN c_custkey % 10 = 0 THEN '20.00' ELSE '0.00' END AS bbox_y, '100.00' AS bbox_w, '50.00' AS bbox_h FROM customer, (VALUES ('Im0'), ('Im1')) AS v(n)""")
def image_manifest(spark, sf_dir):
    from ..sources.pdfs import image_manifest as rows
    from ..sources.pdfs import pdf_images as read

    return rows(read(_sample_pdfs(spark, sf_dir))).drop("path", "ord")
