"""Answers to requests: by a model over a table, by recorded fixtures, or by a server on the loopback interface."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

from brightloom.config.records import Config
from brightloom.core.canonical import canonical_dumps, canonical_loads
from brightloom.core.errors import AdapterError, ValidationError
from brightloom.model.net import JointModel, softmax
from brightloom.serve.protocol import REQUEST, RESPONSE, fixture, validate

#: Bytes of a body that is read, on either side.
MOST_BYTES = 8 << 20
RETRIED = (429, 500, 502, 503, 504)


def answer(request: dict, model: JointModel, feature: Config) -> dict:
    """The model's response to one valid request: greedy labels, tags made valid by promotion."""
    import numpy as np

    from brightloom.signal.kernels import log_mel

    validate(request, REQUEST)
    if request["sample_rate"] != feature["sample_rate"]:
        raise AdapterError(f"the model hears {feature['sample_rate']} Hz")
    mel = log_mel(
        np.array(request["samples"], float), feature["sample_rate"], feature["frame_ms"], feature["hop_ms"], feature["n_fft"], feature["n_mels"], feature["fmin"], feature["fmax"], feature["window"]
    )
    if not len(mel):
        raise AdapterError("shorter than one frame")
    states, _ = model.encode(mel)
    p = softmax(model.intent_logits(states.sum(axis=0), len(states)))
    tags = [model.spec["tags"][i] for i in model.slot_logits(states).argmax(axis=1)]
    promoted = [f"B-{t[2:]}" if t[0] == "I" and (i == 0 or tags[i - 1][2:] != t[2:]) else t for i, t in enumerate(tags)]
    return {
        "schema": "brightloom.response", "schema_version": 1, "request_id": request["request_id"], "intent": model.spec["intents"][int(p.argmax())],
        "posterior": float(p.max()), "frame_tags": promoted, "model_hash": model.model_hash,
    }


def infer(requests: DataFrame, model: JointModel, feature: Config | None = None, column: str = "request") -> DataFrame:
    """``requests`` with ``response`` and ``error``: a request that can't be answered has an error and no response."""
    from pyspark.sql import types as T

    feature = feature or Config("feature", n_mels=model.spec["n_mels"])
    spec, weights, fields = model.spec, model.weights, dict(feature)
    rest = [c for c in requests.columns if c not in ("response", "error")]
    schema = T.StructType([requests.schema[c] for c in rest]).add("response", "string").add("error", "string")

    def run(batches):
        import pyarrow as pa

        from brightloom.core.errors import EngineError

        own, config = JointModel(spec, weights), Config("feature", **{k: v for k, v in fields.items()})
        for batch in batches:
            found, errors = [], []
            for value in batch[column]:
                try:
                    found.append(canonical_dumps(answer(canonical_loads(value.as_py() or ""), own, config)))
                    errors.append(None)
                except EngineError as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(found, pa.string()), pa.array(errors, pa.string())], [*rest, "response", "error"])

    return requests.select(*rest).mapInArrow(run, schema)


class HttpAdapter:
    """Posts requests to a server on this machine; tries again after 429, 5xx and time-outs."""

    def __init__(self, url: str, retries: int = 2, timeout: float = 5.0, wait: float = 0.05, sleep: Callable[[float], None] = time.sleep):
        if urlsplit(url).scheme != "http" or urlsplit(url).hostname not in ("127.0.0.1", "localhost", "::1"):
            raise ValidationError("only http on the loopback interface")
        self.url, self.retries, self.timeout, self.wait, self.sleep = url.rstrip("/"), retries, timeout, wait, sleep

    def infer(self, request: dict) -> dict:
        validate(request, REQUEST)
        body, problem = canonical_dumps(request).encode(), ""
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(self.wait * 2 ** (attempt - 1))
            asked = urllib.request.Request(f"{self.url}/infer", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
                    raw = reply.read(MOST_BYTES + 1)
            except urllib.error.HTTPError as e:
                problem = f"status {e.code}"
                if e.code not in RETRIED:
                    break
                continue
            except (TimeoutError, urllib.error.URLError) as e:
                problem = f"no answer: {e}"
                if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError):
                    continue
                break
            if len(raw) > MOST_BYTES:
                raise AdapterError("the answer is too long")
            try:
                value = canonical_loads(raw)
            except ValidationError as e:
                raise AdapterError(f"the answer is not JSON: {e}") from e
            validate(value, RESPONSE)
            if value["request_id"] != request["request_id"]:
                raise AdapterError("the answer is to another request")
            return value
        raise AdapterError(problem)


class MockServer:
    """Serves fixtures on the loopback interface, for tests and demonstrations; failures and delays can be scripted."""

    def __init__(self, fixtures: list[dict], port: int = 0):
        answers = {f["request"]["request_id"]: f["response"] for f in map(fixture, fixtures)}
        self.failures: deque[int] = deque()
        self.delays: deque[float] = deque()
        self.served = 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def _say(self, status: int, value: dict) -> None:
                raw = canonical_dumps(value).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self) -> None:
                self._say(200 if self.path == "/health" else 404, {"served": outer.served})

            def do_POST(self) -> None:
                outer.served += 1
                if outer.delays:
                    time.sleep(outer.delays.popleft())
                size = int(self.headers.get("Content-Length") or 0)
                raw = self.rfile.read(min(size, MOST_BYTES + 1))
                if outer.failures:
                    return self._say(outer.failures.popleft(), {"error": "scripted"})
                if self.path != "/infer" or size > MOST_BYTES:
                    return self._say(404 if self.path != "/infer" else 413, {"error": "no such place, or too long"})
                try:
                    request = canonical_loads(raw)
                    validate(request, REQUEST)
                except (AdapterError, ValidationError) as e:
                    return self._say(400, {"error": str(e)})
                found = answers.get(request["request_id"])
                return self._say(200, found) if found else self._say(404, {"error": "no fixture"})

            def log_message(self, *args) -> None:
                pass

        self._server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.url = f"http://127.0.0.1:{self._server.server_address[1]}"

    def fail_next(self, status: int, times: int = 1) -> None:
        self.failures.extend([status] * times)

    def delay_next(self, seconds: float, times: int = 1) -> None:
        self.delays.extend([seconds] * times)

    def __enter__(self) -> MockServer:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *error) -> None:
        self._server.shutdown()
        self._server.server_close()

    def serve(self) -> None:
        self._server.serve_forever()


def read_fixtures(path: str) -> list[dict]:
    with open(path, "rb") as f:
        value = canonical_loads(f.read())
    if not isinstance(value, dict) or not isinstance(value.get("fixtures"), list):
        raise ValidationError("not a file of fixtures")
    return [fixture(x) for x in value["fixtures"]]


def write_fixtures(path: str, fixtures: list[dict]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"fixtures": [fixture(x) for x in fixtures]}, f, ensure_ascii=False)
