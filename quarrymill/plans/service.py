"""The engine over HTTP: JSON in and out, a run's changes as server-sent events.

Routes that write ask for a bearer token where one is set; reading and parsing are open. A run is submitted and, unless the caller waits,
executed by a thread of the pool; its state is in the run store, so any process on the same store can show or cancel it.
"""

from __future__ import annotations

import hmac
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from .engine import Engine, IngestError
from .pipeline import Judge

_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def whole(name: str, default: int) -> int:
    """A number from the environment; the default where it is none."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return default


def switch(name: str, default: bool) -> bool:
    """A switch from the environment; the default where it is neither on nor off."""
    said = os.environ.get(name, "").strip().lower()
    return said in _TRUE if said in _TRUE + _FALSE else default


@dataclass
class Settings:
    host: str = "127.0.0.1"
    port: int = 8088
    token: str = ""
    parallel: int = 2
    reap: bool = True

    @classmethod
    def of_environment(cls) -> Settings:
        """QUARRYMILL_HOST, _PORT, _TOKEN, _PARALLEL, _REAP."""
        own = cls()
        return cls(os.environ.get("QUARRYMILL_HOST", own.host), whole("QUARRYMILL_PORT", own.port), os.environ.get("QUARRYMILL_TOKEN", ""), whole("QUARRYMILL_PARALLEL", own.parallel), switch("QUARRYMILL_REAP", own.reap))


class Service:
    """What each route does; `answer` gives a status and a JSON value, or an iterator of events."""

    def __init__(self, engine: Engine, settings: Settings | None = None):
        self.engine, self.settings = engine, settings or Settings()
        self.pool = ThreadPoolExecutor(self.settings.parallel)
        if self.settings.reap:
            engine.store.reap()
        run = r"/v1/runs/(?P<run_id>[\w-]+)"
        #: Method, path, what it does, whether it asks for the token.
        self.routes = [
            ("GET", "/v1/healthz", self.health, False),
            ("GET", "/v1/layers", lambda q, b: {"layers": engine.layers()}, False),
            ("POST", "/v1/pipelines/validate", self.validate, True),
            ("POST", "/v1/parse", self.parse, False),
            ("POST", "/v1/runs", self.submit, True),
            ("GET", "/v1/runs", lambda q, b: {"runs": [asdict(r) for r in engine.list(q.get("state"), int(q.get("limit", 50)))]}, False),
            ("GET", run, lambda q, b: asdict(engine.get(q["run_id"])), False),
            ("POST", f"{run}/resume", self.resume, True),
            ("POST", f"{run}/cancel", lambda q, b: asdict(engine.cancel(q["run_id"])), True),
            ("GET", f"{run}/events", self.events, False),
        ]

    def health(self, q: dict, b: dict) -> dict[str, Any]:
        return self.engine.health() | {"routes": [f"{m} {re.sub(r'[(][^)]*[)]', '<run>', p)}" for m, p, _, _ in self.routes]}

    def validate(self, q: dict, b: dict) -> dict[str, Any]:
        wrong = self.engine.validate(b)
        return {"ok": not wrong, "errors": wrong}

    def parse(self, q: dict, b: dict) -> dict[str, Any]:
        """Chunks of one text; nothing is stored."""
        docs = self.engine.spark.createDataFrame([(str(b.get("name", "document")), b.get("text", ""))], "doc string, text string")
        return {"chunks": [r.asDict(True) for r in self.engine.parse(docs, b.get("strategy", "plain_text"), **b.get("options", {})).collect()]}

    def submit(self, q: dict, b: dict) -> dict[str, Any]:
        judge = Judge(**b["judge"]) if b.get("judge") else None
        run = self.engine.submit(b["pipeline"], b.get("documents", []), judge)
        return asdict(self._execute(run, b.get("wait", False)))

    def resume(self, q: dict, b: dict) -> dict[str, Any]:
        run = self.engine.get(q["run_id"])
        if run.state != "suspended":
            raise IngestError(f"run {run.run_id} is {run.state}, not suspended", 409)
        if b.get("wait", False):
            return asdict(self.engine.resume(run.run_id, b.get("decision", "")))
        self.pool.submit(self.engine.resume, run.run_id, b.get("decision", ""))
        return asdict(run)

    def _execute(self, run, wait: bool):
        if wait:
            return self.engine.execute(run)
        self.pool.submit(self.engine.execute, run)
        return run

    def events(self, q: dict, b: dict):
        self.engine.get(q["run_id"])  # an unknown run is an error, not an empty stream
        return self.engine.events(q["run_id"])

    def answer(self, method: str, target: str, body: bytes, authorization: str = "") -> tuple[int, Any]:
        url = urlsplit(target)
        fits = [(m, f, guarded, found) for m, p, f, guarded in self.routes if (found := re.fullmatch(p, url.path))]
        own = [x for x in fits if x[0] == method]
        if not own:
            return (405, {"detail": "the path has other methods"}) if fits else (404, {"detail": "no such path"})
        _, do, guarded, found = own[0]
        token = self.settings.token
        if guarded and token and not hmac.compare_digest(authorization.encode(), f"Bearer {token}".encode()):
            return 401, {"detail": "a bearer token is needed"}
        try:
            said = json.loads(body) if body else {}
            return 200, do(dict(parse_qsl(url.query)) | found.groupdict(), said)
        except IngestError as e:
            return e.status, {"detail": e.detail}
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            return 422, {"detail": f"{type(e).__name__}: {e}"}


def server(service: Service) -> ThreadingHTTPServer:
    """A server on the service's host and port; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = service.answer(self.command, self.path, body, self.headers.get("Authorization", ""))
            stream = not isinstance(value, (dict, list))
            self.send_response(status)
            self.send_header("Content-Type", "text/event-stream" if stream else "application/json")
            if not stream:
                data = json.dumps(value, default=str).encode()
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
                return
            self.send_header("Cache-Control", "no-store")
            self.end_headers()
            for snapshot in value:
                self.wfile.write(f"data: {json.dumps(snapshot, default=str)}\n\n".encode())
                self.wfile.flush()

        do_GET = do_POST = _reply

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((service.settings.host, service.settings.port), Handler)
