"""A small HTTP front: the queries of an engine as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from lodestone.operators.highlight import with_snippets
from lodestone.operators.search import Engine
from lodestone.operators.semantic import SemanticEngine
from lodestone.plans.query import ParseError


def answer(engine: Engine, semantic: SemanticEngine | None, path: str) -> tuple[int, object]:
    """(status, content) of a request such as /search?q=..&limit=.. : the query and what it found. An error in the query is 400, an unknown document or path 404.

    A limit that isn't a number, or is missing, means all results.
    """
    parts = urlsplit(path)
    given = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    text, limit = given.get("q", ""), given.get("limit", "")
    limit = int(limit) if limit.lstrip("+-").isascii() and limit.lstrip("+-").isdigit() else 0

    def hits(results) -> list[dict]:
        found = results.join(engine.index.docs.select("doc_id", "text"), "doc_id").orderBy(F.desc("score"), "doc_id")
        return [{"id": r.doc_id, "score": r.score, "text": r.text} for r in found.collect()]

    try:
        match parts.path:
            case "/search":
                return 200, {"query": text, "hits": hits(engine.search(text, limit))}
            case "/searchbool":
                return 200, {"query": text, "hits": hits(engine.search_bool(text))}
            case "/wildcard":
                return 200, {"pattern": text, "terms": [r.term for r in engine.expand_wildcard(text).collect()], "hits": hits(engine.search_wildcard(text))}
            case "/semantic" if semantic is not None:
                return 200, {"query": text, "hits": hits(semantic.search(text, limit))}
            case "/suggest":
                better, changed = engine.did_you_mean(text)
                return 200, {"query": text, "suggestion": better, "changed": changed}
            case "/facet":
                field = given.get("field", "")
                return 200, {"query": text, "field": field, "counts": {r.value: r.n for r in engine.facet(text, field).collect()}}
            case "/snippet":
                key = given.get("id", "")
                shown = with_snippets(engine.index.document(key).limit(1).select("text"), sorted(set(engine.compile(text).terms)), engine.index.analyzer).collect()
                return (200, {"id": key, "query": text, "snippet": shown[0].snippet}) if shown else (404, {"error": "document not found"})
            case "/stats":
                row = engine.stats().first()
                return 200, {"documents": row.n_docs, "terms": row.n_terms, "avg_length": row.avg_length}
        return 404, {"error": "no such path"}
    except (ParseError, ValueError) as e:
        return 400, {"error": str(e)}


def serve(engine: Engine, semantic: SemanticEngine | None = None, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, content = answer(engine, semantic, self.path)
            data = json.dumps(content, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
