"""The engine over HTTP, with the standard library alone. `python -m heronry.plans.server` serves an empty engine, or a stored index."""

from __future__ import annotations

import argparse
import hmac
import html
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from ..operators.embedding import local_embedder
from ..operators.router import PROFILES, STRATEGIES
from ..sources.store import Store
from .engine import Engine
from .trace import TraceStore

PUBLIC = {"/health", "/openapi.json", "/docs"}
BODY_BYTES = 10 << 20
DOCUMENTS = "id string, content string, metadata map<string,string>"


_TEXT, _WHOLE, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer", "minimum": 1}, {"type": "number"}, {"type": "boolean"}
_MAP = {"type": "object", "additionalProperties": True}


def _object(required: tuple[str, ...] = (), **fields: Any) -> dict[str, Any]:
    return {"type": "object", "properties": fields} | ({"required": list(required)} if required else {})


def _list(of: dict[str, Any]) -> dict[str, Any]:
    return {"type": "array", "items": of}


_DOCUMENT = _object(("id", "content"), id=_TEXT, content=_TEXT, metadata=_MAP)
_DECISION = _object(strategy={"type": "string", "enum": list(STRATEGIES)}, reasons=_list(_TEXT), reranked=_FLAG, signals=_MAP)
_TRACE = _object(id=_TEXT, query=_TEXT, started_at={"type": "string", "format": "date-time"}, total_ms=_NUMBER, spans=_list(_MAP), decision=_DECISION, router=_TEXT, ad_hoc=_FLAG, ad_hoc_cache_hit=_FLAG)
_HIT = _object(query_id={"type": "integer"}, rank=_WHOLE, chunk_id=_TEXT, document_id=_TEXT, content=_TEXT, index={"type": "integer"}, metadata=_MAP, score=_NUMBER, vector_score=_NUMBER, keyword_score=_NUMBER)
_SEARCH = _object(("query",), query=_TEXT, topK=_WHOLE, forceStrategy=_DECISION["properties"]["strategy"], latencyBudgetMs=_NUMBER, minScore=_NUMBER, filter=_MAP, documents=_list(_DOCUMENT))
_OK = _object(ok=_FLAG)
#: What each route answers, what it takes, and what goes wrong.
CONTRACT: dict[tuple[str, str], tuple[str, dict[str, Any], dict[str, Any] | None]] = {
    ("GET", "/health"): ("Whether the server is up", _object(status=_TEXT), None),
    ("GET", "/openapi.json"): ("This description", _MAP, None),
    ("GET", "/docs"): ("This description, to read", _MAP, None),
    ("POST", "/index"): ("Adds documents", _object(documents={"type": "integer"}, chunks={"type": "integer"}, trace=_MAP), _object(("documents",), documents=_list(_DOCUMENT))),
    ("POST", "/search"): ("Searches the index, or the documents of the request", _object(results=_list(_HIT), trace=_TRACE), _SEARCH),
    ("GET", "/traces"): ("The last traces, newest first", _object(traces=_list(_TRACE)), None),
    ("DELETE", "/traces"): ("Forgets all traces", _OK, None),
    ("GET", "/traces/{id}"): ("One trace", _TRACE, None),
    ("GET", "/admin/stats"): ("Sizes", _object(chunks={"type": "integer"}, traces={"type": "integer"}), None),
    ("POST", "/admin/clear"): ("Empties the index", _OK, None),
}


def specification() -> dict[str, Any]:
    """The OpenAPI description of all routes."""
    paths: dict[str, dict[str, Any]] = {}
    for (method, path), (summary, answer, body) in CONTRACT.items():
        content = lambda schema: {"content": {"application/json": {"schema": schema}}}
        failures = {"400": "The request is malformed"} if body else {}
        if path not in PUBLIC:
            failures |= {"401": "The API key is wrong or missing"}
        if path.startswith("/admin/") or method == "DELETE":
            failures["503"] = "No API key is set, so that this is off"
        if "{id}" in path:
            failures["404"] = "There is none"
        wrong = content(_object(error=_TEXT))
        operation = {"summary": summary, "responses": {"200": {"description": summary} | content(answer)} | {k: {"description": v} | wrong for k, v in failures.items()}}
        if body:
            operation["requestBody"] = {"required": True} | content(body)
        if path not in PUBLIC:
            operation["security"] = [{"bearer": []}, {"key": []}]
        if "{id}" in path:
            operation["parameters"] = [{"name": "id", "in": "path", "required": True, "schema": _TEXT}]
        if (method, path) == ("GET", "/traces"):
            operation["parameters"] = [{"name": "limit", "in": "query", "schema": {"type": "integer", "minimum": 1, "maximum": 500, "default": 100}}]
        paths.setdefault(path, {})[method.lower()] = operation
    schemes = {"bearer": {"type": "http", "scheme": "bearer"}, "key": {"type": "apiKey", "in": "header", "name": "x-api-key"}}
    return {"openapi": "3.1.0", "info": {"title": "heronry", "version": "1"}, "paths": paths, "components": {"securitySchemes": schemes}}


class Page(str):
    """An answer that is HTML."""


def page(spec: dict[str, Any]) -> str:
    rows = [f"<h2>{m.upper()} {html.escape(p)}</h2><p>{html.escape(o['summary'])}</p><pre>{html.escape(json.dumps(o, indent=1))}</pre>" for p, ms in spec["paths"].items() for m, o in ms.items()]
    return f"<!doctype html><title>{spec['info']['title']}</title><h1>{spec['info']['title']}</h1>{''.join(rows)}"


class Problem(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


class Service:
    """What requests do, without HTTP: call(method, target, body, headers) gives (status, answer)."""

    def __init__(self, engine: Engine, api_key: str | None = None):
        self.engine, self.api_key = engine, api_key
        self.traces = engine.trace_store = engine.trace_store or TraceStore(2000)

    def call(self, method: str, target: str, body: bytes = b"", headers: dict[str, str] | None = None) -> tuple[int, Any]:
        url = urlparse(target)
        try:
            self._allow(method, url.path, headers or {})
            return 200, self._answer(method, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body)
        except Problem as e:
            return e.status, {"error": str(e)}

    def _allow(self, method: str, path: str, headers: dict[str, str]) -> None:
        if path in PUBLIC:
            return
        destructive = path.startswith("/admin/") or (method == "DELETE" and path == "/traces")
        if not self.api_key:
            if destructive:
                raise Problem(503, "set an API key to use this")
            return
        given = {k.lower(): v for k, v in headers.items()}
        token = given.get("x-api-key") or given.get("authorization", "").removeprefix("Bearer ")
        if not hmac.compare_digest(token.encode(), self.api_key.encode()):
            raise Problem(401, "wrong or missing API key")

    def _answer(self, method: str, path: str, query: dict[str, str], body: bytes) -> Any:
        engine, spark = self.engine, self.engine.spark
        if method == "GET" and path == "/health":
            return {"status": "ok"}
        if method == "GET" and path == "/openapi.json":
            return specification()
        if method == "GET" and path == "/docs":
            return Page(page(specification()))
        if method == "POST" and path == "/index":
            docs = self._read(body).get("documents")
            if not isinstance(docs, list) or not all(isinstance(d, dict) and isinstance(d.get("id"), str) and isinstance(d.get("content"), str) for d in docs):
                raise Problem(400, "documents must be a list of objects with id and content")
            return engine.index(spark.createDataFrame([_document(d) for d in docs], DOCUMENTS))
        if method == "POST" and path == "/search":
            request = self._read(body)
            if not isinstance(request.get("query"), str):
                raise Problem(400, "query must be a string")
            names = {"topK": "top_k", "forceStrategy": "force_strategy", "latencyBudgetMs": "latency_budget_ms", "filter": "filter", "minScore": "min_score"}
            fields = {to: request[k] for k, to in names.items() if k in request}
            own = request.get("documents")
            found = engine.search(request["query"], spark.createDataFrame([_document(d) for d in own], DOCUMENTS) if own else None, **fields)
            decision = found.decisions.first().asDict(recursive=True)
            return {"results": [r.asDict(recursive=True) for r in found.results.orderBy("rank").collect()], "trace": found.trace | {"decision": decision["decision"] | {"signals": decision["signals"]}}}
        if path == "/traces" and method == "GET":
            wanted = int(query["limit"]) if query.get("limit", "").isdigit() else 0
            return {"traces": self.traces.list(min(wanted or 100, 500))}
        if path == "/traces" and method == "DELETE":
            self.traces.clear()
            return {"ok": True}
        if path.startswith("/traces/") and method == "GET":
            if found := self.traces.get(path.removeprefix("/traces/")):
                return found
            raise Problem(404, "no such trace")
        if path == "/admin/clear" and method == "POST":
            engine.clear()
            return {"ok": True}
        if path == "/admin/stats" and method == "GET":
            return {"chunks": engine.count(), "traces": self.traces.size}
        raise Problem(404, "no such path")

    @staticmethod
    def _read(body: bytes) -> dict[str, Any]:
        try:
            out = json.loads(body)
        except ValueError:
            raise Problem(400, "the body is no JSON") from None
        if not isinstance(out, dict):
            raise Problem(400, "the body must be an object")
        return out


def _document(d: dict[str, Any]) -> tuple[str, str, dict[str, str]]:
    return d["id"], d["content"], {k: v if isinstance(v, str) else json.dumps(v) for k, v in (d.get("metadata") or {}).items()}


def serve(service: Service, host: str, port: int, cors: bool = False) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, answer = (413, {"error": "the body is too large"}) if size > BODY_BYTES else service.call(self.command, self.path, self.rfile.read(size), dict(self.headers))
            read = isinstance(answer, Page)
            raw = (answer if read else json.dumps(answer, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if read else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            if cors:
                self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = _do  # noqa: N815

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def engine_of(spark: SparkSession, store: str | None = None, embedder: str | None = None, profile: str = "in-memory", auto_language_filter: bool = False) -> Engine:
    """An engine as the command line asks for it: over a stored index or an empty one, with the built-in embedder or a local model's."""
    if profile not in PROFILES:
        raise ValueError(f"the profile must be one of {', '.join(PROFILES)}")
    engine = Engine(spark, local_embedder(embedder) if embedder else None, capabilities=PROFILES[profile], auto_language_filter=auto_language_filter)
    if store:
        held = Store(spark, store, indexed=True)
        held.migrate()
        engine.attach(held.read(), held.index().postings)
    return engine


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--host", default=os.environ.get("HOST", "127.0.0.1"))
    p.add_argument("--port", type=int, default=int(os.environ.get("PORT", 3001)))
    p.add_argument("--cors", action="store_true")
    p.add_argument("--store", default=os.environ.get("HERONRY_STORE"), help="folder of a stored index to serve")
    p.add_argument("--embedder", default=os.environ.get("HERONRY_EMBEDDER"), help="name or path of a local sentence model")
    p.add_argument("--profile", default=os.environ.get("HERONRY_PROFILE", "in-memory"), help="kind of store whose capabilities decide on routes")
    p.add_argument("--auto-language-filter", action="store_true", default=os.environ.get("HERONRY_AUTO_LANGUAGE_FILTER") == "1")
    args = p.parse_args()
    key = os.environ.get("API_KEY")
    if args.host not in ("127.0.0.1", "localhost", "::1") and not key:
        print(f"{args.host}:{args.port} is open to others without an API key: what deletes is off, the rest is not", file=sys.stderr)
    engine = engine_of(SparkSession.builder.getOrCreate(), args.store, args.embedder, args.profile, args.auto_language_filter)
    serve(Service(engine, key), args.host, args.port, args.cors).serve_forever()


if __name__ == "__main__":
    main()
