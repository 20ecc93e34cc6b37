import json
import threading
import urllib.error
import urllib.request
from dataclasses import asdict

import pytest

from quarrymill.plans.engine import IngestError, Run
from quarrymill.plans.pipeline import Pipeline
from quarrymill.plans.service import Service, Settings, server, switch, whole
from quarrymill.sources.readers import read_pages


class Store:
    def reap(self):
        return 0


class Engine:
    """Keeps runs in memory; a run completes when it is executed."""

    def __init__(self):
        self.store, self.runs = Store(), {}

    def health(self):
        return {"status": "ok"}

    def layers(self):
        return [{"name": "llm"}]

    def validate(self, p):
        return Pipeline.parse(p).validate()

    def submit(self, pipeline, documents, judge=None):
        if not documents:
            raise IngestError("no documents")
        self.runs["r1"] = Run("r1", pipeline, documents, asdict(judge) if judge else None)
        return self.runs["r1"]

    def execute(self, run):
        run.state = "completed"
        return run

    def get(self, run_id):
        if run_id not in self.runs:
            raise IngestError("no run", 404)
        return self.runs[run_id]

    def list(self, state=None, limit=50):
        return [r for r in self.runs.values() if state in (None, r.state)][:limit]

    def cancel(self, run_id):
        self.get(run_id).state = "cancelled"
        return self.get(run_id)

    def resume(self, run_id, decision):
        return self.execute(self.get(run_id))

    def events(self, run_id):
        yield {"state": "running"}
        yield asdict(self.get(run_id))


@pytest.fixture
def base():
    s = server(Service(Engine(), Settings(port=0, token="secret")))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def call(url, body=None, token=None):
    r = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(r, timeout=10) as a:
            return a.status, a.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_routes(base):
    p = Pipeline("a test", "db").entity("org", "a firm").llm(["org"]).build()
    assert call(f"{base}/v1/healthz")[0] == 200 and "POST /v1/runs/<run>/resume" in call(f"{base}/v1/healthz")[1]
    assert json.loads(call(f"{base}/v1/layers")[1]) == {"layers": [{"name": "llm"}]}
    assert call(f"{base}/v1/runs", {"pipeline": p, "documents": ["a"]})[0] == 401
    assert call(f"{base}/v1/runs", {"pipeline": p, "documents": []}, "secret")[0] == 422
    assert call(f"{base}/v1/runs", {}, "secret")[0] == 422 and call(f"{base}/v1/nothing")[0] == 404 and call(f"{base}/v1/layers", {})[0] == 405
    status, said = call(f"{base}/v1/runs", {"pipeline": p, "documents": ["a"], "wait": True, "judge": {"on_suspicion": "suspend"}}, "secret")
    assert status == 200 and json.loads(said)["state"] == "completed"
    assert call(f"{base}/v1/runs/none")[0] == 404 and call(f"{base}/v1/runs/r1/resume", {"decision": "retry"}, "secret")[0] == 409
    assert len(json.loads(call(f"{base}/v1/runs?state=completed&limit=5")[1])["runs"]) == 1
    events = [json.loads(x.removeprefix("data: ")) for x in call(f"{base}/v1/runs/r1/events")[1].strip().split("\n\n")]
    assert [e["state"] for e in events] == ["running", "completed"]
    assert json.loads(call(f"{base}/v1/runs/r1/cancel", {}, "secret")[1])["state"] == "cancelled"
    assert json.loads(call(f"{base}/v1/pipelines/validate", p, "secret")[1]) == {"ok": True, "errors": []}


def test_environment(monkeypatch):
    monkeypatch.setenv("QUARRYMILL_PORT", "x1")
    monkeypatch.setenv("QUARRYMILL_REAP", "off")
    assert whole("QUARRYMILL_PORT", 7) == 7 and switch("QUARRYMILL_REAP", True) is False and switch("QUARRYMILL_NONE", True) is True
    assert Settings.of_environment() == Settings(reap=False)


def test_pages():
    asked = []

    def fetch(skip, limit):
        asked.append((skip, limit))
        return list(range(skip, min(skip + limit, 25)))

    assert list(read_pages(fetch, 10)) == list(range(25)) and asked == [(0, 10), (10, 10), (20, 10)]
    assert list(read_pages(lambda s, n: [], 10)) == []
