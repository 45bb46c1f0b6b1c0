"""The engine behind one object, and a small HTTP front for it."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from findwell.operators.search import Documents, Search, SearchFailure, list_ids
from findwell.plans.query import QueryError, SearchRequest
from findwell.streaming import apply

_REQUIRED = ("query", "limit", "offset", "consistency")


def request_of(body: dict) -> SearchRequest:
    """A request from its JSON form. The first four fields must be there; lists may be left out."""
    missing = [k for k in _REQUIRED if k not in body]
    if missing:
        raise QueryError(f"missing: {', '.join(missing)}")
    boosts = body.get("boost_fields", [])
    pairs = boosts.items() if isinstance(boosts, dict) else [(b["field"], b["boost"]) for b in boosts]
    return SearchRequest(
        str(body["query"]), int(body["limit"]), int(body["offset"]), int(body["consistency"]), tuple(body.get("default_fields", ())),
        tuple(body.get("facet_fields", ())), tuple((f, float(b)) for f, b in pairs), bool(body.get("group_by_partition", False)),
    )


class Engine:
    """Documents kept in snapshots: batches in, searches and listings out."""

    def __init__(self, spark: SparkSession, where: str, make: Callable[[DataFrame], Documents], clock: Callable[[], int] | None = None):
        self.spark, self.where, self.make, self.clock = spark, where, make, clock

    def documents(self) -> Documents:
        return self.make(apply.current(self.spark, self.where))

    def apply_batch(self, ops: DataFrame) -> int:
        """Apply operations as the next version; returns its number."""
        number = max(apply.versions(self.spark, self.where), default=-1) + 1
        apply.writer(self.where)(ops, number)
        return number

    def search(self, request: SearchRequest):
        return Search(self.documents(), request, self.clock() if self.clock else None).run()

    def list_ids(self, partition_key: str) -> list[str]:
        return sorted(r["id"] for r in list_ids(self.documents(), partition_key).collect())

    def health(self) -> dict:
        return {"status": "ok", "versions": len(apply.versions(self.spark, self.where))}


def serve(engine: Engine, port: int = 0) -> ThreadingHTTPServer:
    """A server with POST /api/v1/search and GET /api/health; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(200, engine.health()) if self.path == "/api/health" else self.answer(404, {"message": "no such path", "errors": []})

        def do_POST(self) -> None:
            if self.path != "/api/v1/search":
                self.answer(404, {"message": "no such path", "errors": []})
                return
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                r = engine.search(request_of(body))
            except (QueryError, ValueError, TypeError, KeyError) as e:
                self.answer(400, {"message": str(e), "errors": []})
            except SearchFailure as e:
                self.answer(500, {"message": e.message, "errors": e.errors})
            else:
                facets = {f: [{"value": v, "count": n} for v, n in b] for f, b in r.facets.items()}
                self.answer(200, {"hits": r.hits, "total_hits": r.total_hits, "duration_ms": r.duration_ms, "facets": facets})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
