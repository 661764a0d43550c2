"""The request surface without sockets: method, path, query parameters and body in; status and JSON value out."""

from __future__ import annotations

import json
from urllib.parse import unquote

from ..model import MAX_MESSAGE_BODY, MAX_SESSION_BODY, EngineError, InvalidArgument, MessageFilter, NotFound
from .tools import Engine, rows_json


class Routes:
    """Nine routes over an engine; ``request`` is what a transport would call."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def request(self, method: str, path: str, params: dict[str, str] | None = None, body: bytes = b"") -> tuple[int, object]:
        parts = [unquote(p) for p in path.strip("/").split("/")]
        params = params or {}
        try:
            match (method, parts):
                case ("POST", ["api", "sessions"]):
                    doc = self._body(body, MAX_SESSION_BODY)
                    return 201, self.engine.create_session(doc.get("target", ""), doc.get("metadata") or "")
                case ("GET", ["api", "sessions"]):
                    return 200, rows_json(self.engine.list_sessions())
                case ("GET", ["api", "sessions", ident]):
                    return 200, self.engine.get_session(ident)
                case ("DELETE", ["api", "sessions", ident]):
                    self.engine.store.delete_session(ident)
                    return 204, None
                case ("POST", ["api", "sessions", ident, "messages"]):
                    doc = self._body(body, MAX_MESSAGE_BODY)
                    own = {k: doc[k] for k in ("role", "type", "content", "sender_id", "subject_id", "metadata") if doc.get(k) is not None}
                    missing = [k for k in ("role", "type", "content") if k not in own]
                    if missing:
                        raise InvalidArgument(f"missing {', '.join(missing)}")
                    return 201, self.engine.deposit_message(ident, **own)
                case ("GET", ["api", "sessions", ident, "messages"]):
                    return 200, self._messages(MessageFilter.from_params(params | {"session_id": ident}), params)
                case ("GET", ["api", "sessions", ident, "messages", "latest"]):
                    return 200, self._latest(MessageFilter.from_params(params | {"session_id": ident}), params)
                # searches across sessions: no session in the path, and never the bare content
                case ("GET", ["api", "messages"]):
                    return 200, self._messages(MessageFilter.from_params(params | {"session_id": ""}), {})
                case ("GET", ["api", "messages", "latest"]):
                    return 200, self._latest(MessageFilter.from_params(params | {"session_id": ""}), {})
            return 404, {"error": "no such route"}
        except EngineError as e:
            return e.status, {"error": str(e)}
        except Exception as e:  # anything else is the server's fault
            return 500, {"error": str(e) or type(e).__name__}

    @staticmethod
    def _body(body: bytes, most: int) -> dict:
        if len(body) > most:
            raise InvalidArgument(f"body is larger than {most} bytes")
        try:
            doc = json.loads(body)
        except ValueError as e:
            raise InvalidArgument(f"body is no JSON: {e}") from None
        if not isinstance(doc, dict):
            raise InvalidArgument("body is no JSON object")
        return doc

    def _messages(self, wanted: MessageFilter, params: dict[str, str]) -> object:
        rows = rows_json(self.engine.store.get_messages(wanted))
        return json.loads(rows[0]["content"]) if params.get("format") == "raw" and len(rows) == 1 else rows

    def _latest(self, wanted: MessageFilter, params: dict[str, str]) -> object:
        rows = rows_json(self.engine.store.latest_message(wanted))
        if not rows:
            raise NotFound("no matching message")
        return json.loads(rows[0]["content"]) if params.get("format") == "raw" else rows[0]
