"""The engine's tables as views of the driver's tables, each as a DataFrame and as the SQL of its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c: str):
    return F.date_format(c, STAMP)


MESSAGES_SQL = """
    SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id,
           CASE user_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'orchestrator' ELSE 'user' END AS role,
           'u' || CAST(user_id AS VARCHAR) AS sender_id, event_type AS type,
           json_extract_string(props, '$.k') AS subject_id, props AS content, ts AS created_at, CAST(NULL AS VARCHAR) AS metadata
    FROM events"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("user_id") % 3 == 0, "agent").when(F.col("user_id") % 3 == 1, "orchestrator").otherwise("user")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        role.alias("role"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender_id"),
        F.col("event_type").alias("type"),
        F.get_json_object("props", "$.k").alias("subject_id"),
        F.col("props").alias("content"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("string").alias("metadata"),
    )


_STATUS_SQL = "CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'done' ELSE 'abandoned' END"
TASKS_SQL = f"""
    SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, 'agent' AS role, CAST(NULL AS VARCHAR) AS sender_id,
           CASE WHEN event_type = 'click' THEN 'task' ELSE event_type END AS type, 'task-' || json_extract_string(props, '$.k') AS subject_id,
           '{{"title":"t' || CAST(event_id AS VARCHAR) || '","status":"' || {_STATUS_SQL} || '"}}' AS content, ts AS created_at, CAST(NULL AS VARCHAR) AS metadata
    FROM events"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'done' ELSE 'abandoned' END")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.lit("agent").alias("role"),
        F.lit(None).cast("string").alias("sender_id"),
        F.when(F.col("event_type") == "click", "task").otherwise(F.col("event_type")).alias("type"),
        F.concat(F.lit("task-"), F.get_json_object("props", "$.k")).alias("subject_id"),
        F.concat(F.lit('{"title":"t'), F.col("event_id").cast("string"), F.lit('","status":"'), status, F.lit('"}')).alias("content"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("string").alias("metadata"),
    )


SESSIONS_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'cust-' || CAST(o_custkey AS VARCHAR) AS target,
           CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'complete' ELSE 'failed' END AS status,
           o_orderdate AS created_at, o_orderpriority AS metadata
    FROM orders"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "complete").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("target"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("metadata"))


PAYLOADS_SQL = """
    SELECT event_id AS id, CASE event_id % 14
        WHEN 0 THEN '{"title":"t' || CAST(event_id AS VARCHAR) || '","status":"new"}'
        WHEN 1 THEN '{"title":"t","status":"done","priority":' || CAST(event_id % 9 AS VARCHAR) || '}'
        WHEN 2 THEN '{"title":"t"}'
        WHEN 3 THEN '{"status":"new","title":5}'
        WHEN 4 THEN '{"title":"t","status":"later"}'
        WHEN 5 THEN '{"title":"t","status":"new","color":"red","area":1}'
        WHEN 6 THEN '[1,2]'
        WHEN 7 THEN 'null'
        WHEN 8 THEN '{"title":"t","status":"new","priority":1.5}'
        WHEN 9 THEN '{"title":null,"status":"new"}'
        WHEN 10 THEN '{"title":"t","status":"new","priority":null}'
        WHEN 11 THEN '{"title":"t","status":"new","priority":-1}'
        WHEN 12 THEN '{"title":{"a":1},"status":"new"}'
        ELSE '{"title":"t","status":"new","notes":[1],"blocker":true}' END AS content
    FROM events"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("_events_for_payloads")
    return spark.sql(PAYLOADS_SQL.replace("FROM events", "FROM _events_for_payloads").replace("AS VARCHAR", "AS STRING"))


#: Documents with the artefacts of extracted text put in, the same way on both sides.
RAW_TEXT_SQL = """
    SELECT doc_id, replace(replace(replace(replace(replace(text,
        ' the ', chr(10) || '-' || chr(10)), ' la ', chr(10) || '–' || chr(10)), '. ', '.' || chr(10) || chr(12) || chr(10)),
        ' and ', ' [' || chr(10) || '3' || chr(10) || '] '), ' de ', ' 1,5' || chr(10) || '–' || chr(10) || '1,8' || chr(10) || chr(10) || chr(10) || chr(10)) AS text
    FROM documents"""


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for old, new in ((" the ", "\n-\n"), (" la ", "\n–\n"), (". ", ".\n\f\n"), (" and ", " [\n3\n] "), (" de ", " 1,5\n–\n1,8\n\n\n\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


#: Two captions and a page marker in every text, of a kind that depends on the document.
CAPTIONED_SQL = """
    SELECT doc_id, '<!-- page 1 -->' || chr(10) || CASE doc_id % 6
            WHEN 0 THEN 'Figure ' || CAST(doc_id % 9 AS VARCHAR) || '-1. Overview' WHEN 1 THEN 'Рисунок ' || CAST(doc_id % 9 AS VARCHAR) || '.2 – схема'
            WHEN 2 THEN 'Рис. 2.1. Вид' WHEN 3 THEN 'Схема №5' WHEN 4 THEN 'see Figure 4-2 there' ELSE 'Table 4-1: rows' END
        || chr(10) || text || chr(10) || '<!-- page 2 -->' || chr(10) || 'Figure 7-3: second' || chr(10) || 'Мал. 4.2' || chr(10) || 'Figure 8-1,not' AS text
    FROM documents"""
MANIFEST_SQL = """
    SELECT doc_id, p AS page, o AS ord, 'd' || CAST(doc_id AS VARCHAR) || '-p' || lpad(CAST(p AS VARCHAR), 4, '0') || '-Im' || CAST(o AS VARCHAR) || '.png' AS file
    FROM documents, (VALUES (1, 0), (2, 0)) AS v(p, o) WHERE doc_id % 5 <> 0 OR p = 2"""


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents_for_captions")
    return spark.sql(CAPTIONED_SQL.replace("FROM documents", "FROM _documents_for_captions").replace("AS VARCHAR", "AS STRING"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents_for_manifest")
    return spark.sql(MANIFEST_SQL.replace("FROM documents", "FROM _documents_for_manifest").replace("AS VARCHAR", "AS STRING"))


_BOX = """
    SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS ord, 'Im' || CAST(l_linenumber AS VARCHAR) AS name,
           CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber * 100.0e0 WHEN CAST(min(l_quantity) AS INT) % 4 = 0 THEN 300.0e0 ELSE 80.0e0 END AS bbox_x,
           CASE WHEN l_orderkey % 3 = 0 THEN 200.0e0 ELSE 1000.0e0 - l_linenumber * 100.07e0 + CASE WHEN CAST(min(l_quantity) AS INT) % 5 = 0 THEN 30.0e0 ELSE 0.0e0 END END AS bbox_y,
           CASE WHEN CAST(min(l_quantity) AS INT) % 11 = 0 THEN 0.0e0 WHEN l_orderkey % 3 = 0 THEN 100.0e0 ELSE 432.0e0 END AS bbox_w,
           CASE WHEN l_orderkey % 3 = 0 THEN 50.0e0 ELSE 100.0e0 END AS bbox_h,
           CAST(min(l_quantity) AS BIGINT) * 10 AS width, CAST(l_linenumber AS BIGINT) * 7 AS height
    FROM lineitem GROUP BY l_orderkey, l_linenumber"""
PANELS_SQL = _BOX


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem_for_panels")
    return spark.sql(_BOX.replace("FROM lineitem", "FROM _lineitem_for_panels").replace("AS VARCHAR", "AS STRING"))
