import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sagalog.model import MESSAGES, FilterRequired, InvalidArgument, MessageFilter, NotFound, SessionCapReached
from sagalog.operators import log
from sagalog.plans.registry import TypeRegistry
from sagalog.sources.store import MessageStore

T0 = dt.datetime(2024, 1, 1)


def messages(spark, rows):
    """rows: (session, role, type, subject, content)"""
    return spark.createDataFrame([(i + 1, s, r, None, t, sub, c, T0 + dt.timedelta(seconds=i), None) for i, (s, r, t, sub, c) in enumerate(rows)], MESSAGES)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters(spark):
    m = messages(spark, [("s", "agent", "task.completed", None, "{}"), ("s", "agent", "task.failed", None, "{}"), ("s", "orchestrator", "task.completed", None, "{}")])
    assert ids(log.get_messages(m, MessageFilter(session_id="s"))) == [1, 2, 3]
    assert ids(log.get_messages(m, MessageFilter(role="agent"))) == [1, 2]
    assert ids(log.get_messages(m, MessageFilter(type="task.completed"))) == [1, 3]
    assert ids(log.get_messages(m, MessageFilter(role="agent", type="task.completed"))) == [1]
    assert ids(log.latest_message(m, MessageFilter(session_id="s"))) == [3]
    assert ids(log.get_messages(m, MessageFilter(session_id="s", limit=2))) == [1, 2]
    assert ids(log.latest_message(m, MessageFilter(session_id="none"))) == []
    for f in (log.get_messages, log.latest_message, log.latest_per_subject):
        with pytest.raises(FilterRequired):
            f(m, MessageFilter(limit=3))


def test_filter_params():
    assert MessageFilter.from_params({"role": "a", "limit": "5"}) == MessageFilter(role="a", limit=5)
    assert MessageFilter.from_params({"limit": "-5", "junk": "x"}).limit == 0 and MessageFilter.from_params({"limit": "x"}).limit == 0


def test_latest_per_subject(spark):
    rows = [("s", "agent", "t", "A", "1"), ("s", "agent", "t", "B", "1"), ("s", "agent", "t", None, "1"), ("s", "agent", "t", "", "1"), ("s", "agent", "t", "A", "2"), ("s", "agent", "t", "B", "2")]
    m = messages(spark, rows)
    assert ids(log.latest_per_subject(m, MessageFilter(type="t"))) == [6, 5]
    assert ids(log.latest_per_subject(m, MessageFilter(type="t", limit=1))) == [6]


def test_ties_go_to_the_larger_id(spark):
    m = messages(spark, [("s", "a", "t", "A", "1"), ("s", "a", "t", "A", "2")]).withColumn("created_at", F.lit(T0))
    assert ids(log.latest_per_subject(m, MessageFilter(type="t"))) == [2]


def test_tasks(spark):
    def task(subject, status):
        return ("s", "agent", "task", subject, f'{{"title":"x","status":"{status}"}}')

    m = messages(spark, [task("in-flight", "new"), task("completed", "new"), task("in-flight", "in-progress"), task("completed", "done"), task("still-new", "new")])
    assert ids(log.list_tasks(m)) == [5, 4, 3]
    assert ids(log.list_tasks(m, status="new")) == [5]
    assert ids(log.list_tasks(m, status="done", limit=1)) == []
    assert ids(log.list_tasks(m, status="done", limit=1, filter_first=True)) == [4]
    with pytest.raises(InvalidArgument):
        log.list_tasks(m, status="lost")
    with pytest.raises(InvalidArgument):
        log.list_tasks(m, limit=501)


def test_filter_reaches_the_scan(spark, tmp_path):
    m = messages(spark, [("s", "agent", "t", "A", "1")])
    m.write.parquet(str(tmp_path / "m"))
    plan = log.latest_per_subject(spark.read.parquet(str(tmp_path / "m")), MessageFilter(type="t"))._jdf.queryExecution().toString()
    assert "EqualTo(type,t)" in plan and "WindowGroupLimit" in plan


def test_store(spark, tmp_path):
    types = TypeRegistry()
    types.register("task.completed", '{"additionalProperties":false,"properties":{"task_id":{"type":"string"},"duration":{"type":"integer","minimum":0}},"required":["task_id"]}', lambda c: F.when(c.contains("forbidden"), "hook says no"))
    store = MessageStore(spark, str(tmp_path / "store"), types, ["agent", "orchestrator"], session_cap=2)
    a = store.create_session("one")
    b = store.create_session("two", "{}")
    with pytest.raises(SessionCapReached):
        store.create_session("three")
    store.set_status(b, "complete")
    assert store.get_session(b)["status"] == "complete" and store.list_sessions().count() == 2
    with pytest.raises(NotFound):
        store.set_status("nobody", "active")
    with pytest.raises(NotFound):
        store.get_session("nobody")
    rows = [
        (a, "agent", "task.completed", '{"task_id":"1"}'),
        (a, "user", "nope", "[]"),
        (a, "agent", "nope", "[]"),
        (a, "agent", "task.completed", "[]"),
        (a, "agent", "task.completed", '{"task_id":"forbidden"}'),
        ("ghost", "agent", "task.completed", '{"task_id":"2"}'),
        (b, "orchestrator", "task.completed", '{"task_id":"3","duration":4}'),
    ]
    bad = store.deposit(spark.createDataFrame(rows, "session_id string, role string, type string, content string"))
    errors = sorted(r["error"].split(" ")[0] for r in bad.collect())
    assert errors == ["hook", "input", "message", "role", "session"]
    assert store.messages.count() == 2
    more = spark.createDataFrame([(a, "agent", "task.completed", '{"task_id":"9"}', "", "S")], "session_id string, role string, type string, content string, sender_id string, subject_id string")
    assert store.deposit(more).count() == 0
    last = store.latest_message(MessageFilter(session_id=a)).first()
    assert last["content"] == '{"task_id":"9"}' and last["sender_id"] is None and last["id"] == max(r["id"] for r in store.messages.collect())
    assert store.raw_contents(store.get_messages(MessageFilter(subject_id="S"))) == '{"task_id":"9"}'
    assert store.raw_contents(store.get_messages(MessageFilter(session_id=a))) is None
    store.delete_session(a)
    store.delete_session("nobody")
    assert store.messages.count() == 1 and store.sessions.count() == 1
    again = MessageStore(spark, str(tmp_path / "store"), types)
    assert again.version() == 2 and again.messages.count() == 1


def test_migration_and_newer_store(spark, tmp_path):
    import json

    path = tmp_path / "old"
    old = spark.createDataFrame([(1, "s", "agent", "task", "{}", T0, None)], "id long, session_id string, role string, type string, content string, created_at timestamp, metadata string")
    old.write.parquet(str(path / "messages" / "x"))
    (path / "CURRENT").write_text(json.dumps({"version": 1, "sessions": [], "messages": ["messages/x"]}))
    store = MessageStore(spark, str(path))
    assert store.version() == 2 and store.messages.first()["subject_id"] is None and (path / "CURRENT.v1").exists()
    (path / ".CURRENT.crc").unlink(missing_ok=True)
    (path / "CURRENT").write_text(json.dumps({"version": 9, "sessions": [], "messages": []}))
    with pytest.raises(Exception, match="version 9"):
        MessageStore(spark, str(path))


def test_cap_admission(spark):
    s = spark.createDataFrame([("a", "active", T0), ("b", "active", T0)], "id string, status string, created_at timestamp")
    new = spark.createDataFrame([(str(i), T0 + dt.timedelta(seconds=i)) for i in range(5)], "id string, created_at timestamp")
    got = {r["id"]: r["admitted"] for r in log.admit_sessions(s, new, 4).collect()}
    assert got == {"0": True, "1": True, "2": False, "3": False, "4": False}


def test_every_session_has_its_place(spark):
    rows = [(f"s{i:04d}", f"2024-01-{1 + i * 7 % 28:02d} 00:00:00") for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, at string").selectExpr("id", "cast(at as timestamp) as created_at")
    got = {r["id"]: r["place"] for r in log.numbered_sessions(df).collect()}
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    assert got == {i: k + 1 for k, i in enumerate(want)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_admission_query_counts_active_sessions(spark, monkeypatch):
    from sagalog.plans import catalog

    seen, real = {}, log.admit_sessions
    monkeypatch.setattr(log, "admit_sessions", lambda s, c, cap: (seen.update(n=s.count(), cap=cap), real(s, c, cap))[1])
    got = catalog.QUERIES["active_session_cap_admission"](spark, "/root/testdata/sf0.001")
    assert seen["n"] > 0 and seen["cap"] == seen["n"] + 100 and got.where("admitted").count() == 100


def test_no_cap_admits_all(spark):
    rows = spark.createDataFrame([(f"s{i}", "active", i) for i in range(5)], "id string, status string, at long").selectExpr("id", "status", "timestamp_seconds(at) as created_at")
    assert log.admit_sessions(rows, rows, 0).where("admitted").count() == 5 == log.admit_sessions(rows, rows, -1).where("admitted").count()
    assert log.admit_sessions(rows, rows, 7).where("admitted").count() == 2
