"""What a service around the plans needs: a gate for ingestion, replies to errors, health, logs as JSON lines."""

from __future__ import annotations

import contextvars
import json
import logging
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW = "LODESTONE_ALLOW_INGEST"


class StoreUnavailable(RuntimeError):
    """A table or collection can't be read."""


class ModelFailed(RuntimeError):
    """A language model gave no reply."""


class EmbeddingFailed(RuntimeError):
    """An embedding model gave no vectors."""


class Refused(RuntimeError):
    """A request that isn't carried out; status says why."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


# Statuses and codes of errors; what isn't listed is an internal error.
REPLIES = {
    StoreUnavailable: (503, "vector_store_unavailable"),
    ModelFailed: (502, "llm_unavailable"),
    EmbeddingFailed: (502, "embedding_failed"),
}
INTERNAL = (500, "internal_error")


def error_reply(error: BaseException) -> tuple[int, dict[str, str]]:
    """(status, body) of an error; nothing of an unexpected one is shown to the caller, it is logged."""
    if isinstance(error, Refused):
        return error.status, {"error": "refused", "detail": str(error)}
    for kind, (status, code) in REPLIES.items():
        if isinstance(error, kind):
            return status, {"error": code, "detail": kind.__doc__ or ""}
    event("unhandled_error", logging.ERROR, error=f"{type(error).__name__}: {error}")
    return INTERNAL[0], {"error": INTERNAL[1], "detail": "Unexpected error."}


class IngestGate:
    """At most one ingestion at a time, and none unless the environment allows it."""

    def __init__(self) -> None:
        self._lock = threading.Lock()

    def run(self, ingest: Callable[[], Any], env: dict[str, str] | None = None) -> Any:
        if (os.environ if env is None else env).get(ALLOW) != "1":
            raise Refused(403, f"Ingestion is off; {ALLOW}=1 turns it on.")
        if not self._lock.acquire(blocking=False):
            raise Refused(409, "An ingestion is running.")
        try:
            return ingest()
        finally:
            self._lock.release()


def health(store: Any, chunks: DataFrame | None) -> tuple[int, dict[str, Any]]:
    """(status, body): whether there is an index, and whether its collection can be read."""
    try:
        ok = bool(store is not None and store.healthy())
    except Exception:  # noqa: BLE001  a store that can't be asked isn't healthy
        ok = False
    body = {"status": "ok" if ok and chunks is not None else "degraded", "index_loaded": chunks is not None, "vector_store": ok, "chunks": chunks.count() if chunks is not None else 0}
    return (200 if body["status"] == "ok" else 503), body


def prometheus(metrics: DataFrame, prefix: str = "lodestone") -> str:
    """A row for each of a few groups (name, columns of numbers) in the text format of Prometheus."""
    name, *numbers = metrics.columns
    lines = []
    for row in metrics.orderBy(name).toLocalIterator():
        lines += [f'{prefix}_{c}{{{name}="{row[name]}"}} {row[c]}' for c in numbers if row[c] is not None]
    return "\n".join(lines) + "\n" if lines else ""


_request: contextvars.ContextVar[str | None] = contextvars.ContextVar("lodestone_request", default=None)
_logger = logging.getLogger("lodestone")


@contextmanager
def request(id_: str | None = None) -> Iterator[str]:
    """Events inside carry the request's id."""
    token = _request.set(id_ or uuid.uuid4().hex[:16])
    try:
        yield _request.get() or ""
    finally:
        _request.reset(token)


class JsonLines(logging.Formatter):
    """One JSON object a line: time, level, event, request id, fields, and the traceback if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime(record.created)), "level": record.levelname, "logger": record.name, "event": record.getMessage()}
        if id_ := _request.get():
            line["request_id"] = id_
        line |= getattr(record, "fields", {})
        if record.exc_info:
            line["exc"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def event(name: str, level: int = logging.INFO, **fields: Any) -> None:
    _logger.log(level, name, extra={"fields": fields})


def log_as_json(handler: logging.Handler | None = None) -> None:
    """Send the package's events to a handler, standard error if none is given, as JSON lines."""
    handler = handler or logging.StreamHandler()
    handler.setFormatter(JsonLines())
    _logger.handlers, _logger.propagate = [handler], False
    _logger.setLevel(logging.INFO)


def latencies(traces: DataFrame, time_column: str, by: str) -> DataFrame:
    """(by, requests, p50, p95) of the latest requests of each group."""
    from ..operators.metrics import latest, service_percentile

    rows = latest(traces, by, [time_column]).groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.collect_list("value").alias("v"))
    return rows.select(by, "requests", service_percentile(F.col("v"), 0.5).alias("p50"), service_percentile(F.col("v"), 0.95).alias("p95"))
