import json

import pytest

from sagalog.plans.tools import Engine
from sagalog.sources import samples
from sagalog.sources.store import MessageStore


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, MessageStore(spark, str(tmp_path_factory.mktemp("engine")), roles=["agent"], session_cap=2))


def test_log_tools(engine):
    assert engine.tool_names() == ["create_session", "deposit_message", "get_latest_message", "get_messages", "get_session", "list_sessions", "list_tasks", "pdf_clean_text", "pdf_extract_images", "pdf_extract_pages", "pdf_extract_text"]
    assert engine.call("list_sessions").data == [] and engine.call("list_tasks").data == []
    a = engine.call("create_session", {"target": "x"}).data
    assert a["status"] == "active" and "metadata" not in a
    assert engine.call("get_session", {"id": a["id"]}).data["target"] == "x"
    assert engine.call("get_session", {"id": "none"}).error["code"] == "not_found"
    bad = engine.call("create_session", {"goal": "x"})
    assert bad.error["code"] == "schema_violation" and bad.error["details"] == {"field": "goal", "valid_fields": ["metadata", "target"]}
    assert engine.call("nothing").error["code"] == "not_found"
    message = {"session_id": a["id"], "role": "agent", "type": "task", "content": {"title": "t", "status": "new"}, "subject_id": "task-1"}
    assert engine.call("deposit_message", message).data["subject_id"] == "task-1"
    assert engine.call("deposit_message", message | {"content": {"title": "t", "status": "done"}}).status == "ok"
    for change, part in (({"role": "ghost"}, "role"), ({"type": "zzz"}, "not registered"), ({"content": {"title": "t"}}, "status"), ({"session_id": "none"}, "does not exist")):
        out = engine.call("deposit_message", message | change)
        assert out.error["code"] == "validation_failed" and part in out.error["message"]
    assert [json.loads(r["content"])["status"] for r in engine.call("list_tasks").data] == ["done"]
    assert engine.call("list_tasks", {"status": "new"}).data == []
    assert engine.call("list_tasks", {"limit": 501}).error["code"] == "schema_violation"
    assert engine.call("get_messages", {"role": "agent", "limit": 1}).metadata == {"count": 1}
    assert engine.call("get_messages").error["code"] == "validation_failed"
    assert engine.call("get_latest_message", {"subject_id": "none"}).error["code"] == "not_found"
    assert engine.get_latest_message(raw=True, session_id=a["id"]) == {"title": "t", "status": "done"}
    assert engine.get_latest_message(raw=True, subject_id="task-1")["subject_id"] == "task-1"
    assert engine.call("create_session", {"target": "y"}).status == "ok"
    assert engine.call("create_session", {"target": "z"}).error["code"] == "session_cap_reached"


def test_document_tools(engine, tmp_path):
    (tmp_path / "a.pdf").write_bytes(samples.pdf_of(20, "low"))
    path = str(tmp_path / "a.pdf")
    assert engine.call("pdf_extract_text", {"path": path}).data == {"text": "Order 20\npriority low\fFigure 20-1. Panels", "page_count": 2}
    assert engine.call("pdf_extract_text", {"path": path, "pages": "2-2"}).data["text"] == "Figure 20-1. Panels"
    assert engine.call("pdf_extract_text", {"path": path, "pages": "2-9"}).error["code"] == "schema_violation"
    assert engine.call("pdf_extract_text", {"path": path, "page": 1, "pages": "2-2"}).error["code"] == "schema_violation"
    assert [r["page"] for r in engine.call("pdf_extract_pages", {"path": path}).data] == [1, 2]
    out = str(tmp_path / "images")
    rows = engine.call("pdf_extract_images", {"path": path, "out_dir": out}).data
    assert [(r["file"], r["name"], r["bbox_h"]) for r in rows] == [("a-p0002-Im0+Im1.png", "Im0+Im1", "100.00")]
    assert (tmp_path / "images" / "a-p0002-Im0+Im1.png").read_bytes().startswith(b"\x89PNG")
    text = engine.pdf_extract_text(path, between="\n\f\n")["text"]
    whole = engine.call("pdf_clean_text", {"text": text, "manifest_path": out + "/manifest.tsv", "imgdir": "img"}).data["markdown"]
    assert whole == "<!-- page 1 -->\n\nOrder 20\npriority low\n\n<!-- page 2 -->\n\n![Figure 20-1](img/a-p0002-Im0+Im1.png)\n\nFigure 20-1. Panels\n"
    assert engine.call("pdf_clean_text", {"text": text, "imgdir": "img"}).error["code"] == "validation_failed"
    single = engine.call("pdf_extract_images", {"path": path, "out_dir": out, "stitch": False}).data
    assert [r["name"] for r in single] == ["Im0", "Im1"]
    (tmp_path / "b.pdf").write_bytes(b"junk")
    for name, more in (("pdf_extract_pages", {}), ("pdf_extract_images", {"out_dir": out})):
        assert engine.call(name, {"path": str(tmp_path / "b.pdf")} | more).error["code"] == "internal_error"
        assert engine.call(name, {"path": str(tmp_path / "none.pdf")} | more).error["code"] == "internal_error"
    assert engine.call("pdf_extract_text", {"path": path, "pages": "2"}).error["code"] == "schema_violation"


def test_no_cap_and_resources(spark, tmp_path):
    engine = Engine(spark, MessageStore(spark, str(tmp_path), session_cap=0))
    assert [engine.call("create_session", {"target": t}).status for t in "pqr"] == ["ok"] * 3
    engine.resources.register("log://open", "open sessions", lambda uri: engine.store.sessions.where("status = 'active'"))
    assert len(engine.read_resource("log://open?x=1").data) == 3 and engine.read_resource("log://shut").error["code"] == "not_found"
    engine.resources.register("log://bad", "fails", lambda uri: 1 / 0)
    assert engine.read_resource("log://bad").error["code"] == "internal_error"


def test_single_deposits_keep_few_segments(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path))
    engine = Engine(spark, store)
    session = engine.call("create_session", {"target": "p"}).data["id"]
    task = {"session_id": session, "role": "r", "type": "task", "content": {"title": "t", "status": "new"}}
    got = [engine.call("deposit_message", task | {"subject_id": f"s{k}"}).data for k in range(18)]
    assert [r["id"] for r in got] == list(range(1, 19)) and [r["subject_id"] for r in got] == [f"s{k}" for k in range(18)]
    assert len(store._state()["messages"]) == 3 and store.messages.count() == 18
    batch = spark.createDataFrame([(session, "r", "task", '{"title":"t","status":"new"}' if k % 3 else "{}") for k in range(60)], "session_id string, role string, type string, content string").repartition(5)
    assert store.deposit(batch).count() == 20
    assert sorted(r["id"] for r in store.messages.collect()) == list(range(1, 59))
    before = store.messages.count()
    assert store.vacuum() >= 16 and store.messages.count() == before and store.vacuum() == 0


def test_routes(spark, tmp_path):
    from sagalog.plans.routes import Routes

    routes = Routes(Engine(spark, MessageStore(spark, str(tmp_path), roles=["agent"], session_cap=1)))
    ask = routes.request
    assert ask("GET", "/api/sessions") == (200, [])
    status, session = ask("POST", "/api/sessions", body=b'{"target":"x"}')
    assert ask("POST", "/api/sessions", body=b'{"target":5}')[0] == 400
    assert status == 201 and ask("POST", "/api/sessions", body=b'{"target":"y"}')[0] == 503
    assert [ask("POST", "/api/sessions", body=b)[0] for b in (b"[]", b"{", b"{}", b'{"target":"' + b"x" * 5000 + b'"}')] == [400] * 4
    home = f"/api/sessions/{session['id']}"
    assert ask("GET", home)[1]["target"] == "x" and ask("GET", "/api/sessions/none")[0] == 404
    assert ask("GET", home + "/messages") == (200, []) and ask("GET", home + "/messages/latest")[0] == 404
    message = {"role": "agent", "type": "task", "content": {"title": "t", "status": "new"}, "subject_id": "S"}
    assert ask("POST", home + "/messages", body=json.dumps(message).encode())[0] == 201
    assert ask("GET", home + "/messages", {"format": "raw"})[1] == message["content"] == ask("GET", home + "/messages/latest", {"format": "raw"})[1]
    assert ask("POST", home + "/messages", body=json.dumps(message | {"role": "x"}).encode())[0] == 400
    assert ask("POST", home + "/messages", body=b'{"role":"agent"}')[0] == 400
    assert ask("POST", "/api/sessions/none/messages", body=json.dumps(message).encode())[0] == 400
    assert ask("GET", "/api/messages")[0] == 400 and ask("GET", "/api/messages", {"subject_id": "S", "format": "raw"})[1][0]["subject_id"] == "S"
    assert ask("GET", "/api/messages/latest", {"subject_id": "S", "limit": "x"})[1]["session_id"] == session["id"]
    assert len(ask("GET", "/api/messages", {"subject_id": "S", "limit": "99999999999"})[1]) == 1
    store, routes.engine.store = routes.engine.store, None
    assert ask("GET", home + "/messages")[0] == 500
    routes.engine.store = store
    assert ask("DELETE", home) == (204, None) == ask("DELETE", home) and ask("GET", "/api/nothing")[0] == 404
