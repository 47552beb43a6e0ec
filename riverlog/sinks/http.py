"""Delivery of entries by HTTP POST, from the executors.

``HttpSink`` is the sink of jobs.  ``riverlog_http`` is the same as a data source
for any table or stream with a ``value`` column of JSON lines::

    lines.write.format("riverlog_http").mode("append").options(
        url="https://collector/in", per_request=100, max_attempts=3,
        dead_letters="/logs/undelivered", report="/logs/reports", **{"header.Authorization": "Bearer $TOKEN"}
    ).save()
"""

from __future__ import annotations

import hashlib
import http.client
import importlib
import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource

from riverlog.model import require
from riverlog.plans.storage import filesystem
from riverlog.sinks.outlets import (
    Branch,
    HttpOutlet,
    Outcome,
    TaskReport,
    _StreamWriter,
    _Writer,
    deliver,
    failure_text,
)
from riverlog.sinks.retry import RetryPolicy

TIMEOUT_SECONDS = 10.0

# post(url, body, headers) -> status code
Post = Callable[[str, bytes, Mapping[str, str]], int]


class DeliveryError(RuntimeError):
    """Some entries could not be delivered."""


def open_client() -> Post:
    """A poster that keeps one connection per host open."""
    connections: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def post(url: str, body: bytes, headers: Mapping[str, str]) -> int:
        parts = urllib.parse.urlsplit(url)
        key = (parts.scheme, parts.netloc)
        if key not in connections:
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            connections[key] = kind(parts.netloc, timeout=TIMEOUT_SECONDS)
        target = parts.path or "/"
        if parts.query:
            target += "?" + parts.query
        try:
            connections[key].request("POST", target, body=body, headers=dict(headers))
            response = connections[key].getresponse()
            response.read()
            return response.status
        except Exception:
            connections.pop(key).close()
            raise

    return post


def outbox_client() -> Post:
    """A poster for the url of a shared folder: every request becomes a file there,
    for a forwarder to pick up.  The name follows the content, so that a request
    made twice is one file."""

    def post(url: str, body: bytes, headers: Mapping[str, str]) -> int:
        store, folder = filesystem(url)
        store.create_dir(folder, recursive=True)
        name = hashlib.sha256(headers.get("Idempotency-Key", "").encode() + body).hexdigest()
        staged = f"{folder}/_{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as out:
            out.write(body)
        store.move(staged, f"{folder}/{name}.json")
        return 201

    return post


def request_headers(custom: Mapping[str, str]) -> dict[str, str]:
    """Headers of every request; ``$NAME`` is replaced from the driver's environment."""
    expanded = {name: os.path.expandvars(value) for name, value in custom.items()}
    lowered = {name.lower() for name in expanded}
    default = {} if "content-type" in lowered else {"Content-Type": "application/json"}
    return {**default, **expanded}


@dataclass(frozen=True)
class HttpSink:
    """POST each entry as JSON, or ``per_request`` entries as one JSON array.

    One client serves a task.  Any answer outside 2xx is a failure.  A failed
    request does not stop the others: failures are counted in the tasks and
    raised once, so a bad entry never makes Spark send a whole task again.  With
    ``dead_letters`` undelivered entries are kept in that folder and not raised.
    """

    url: str
    headers: Mapping[str, str] = field(default_factory=dict)
    per_request: int = 1
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    client: Callable[[], Post] = open_client
    dead_letters: str | None = None

    def __post_init__(self) -> None:
        require(self.url != "", "http sink requires a url")
        require(self.per_request >= 1, "http sink: per_request must be at least 1")

    def request_headers(self) -> dict[str, str]:
        return request_headers(self.headers)

    def outlet(self) -> HttpOutlet:
        return HttpOutlet(
            "http sink",
            self.retry,
            self.dead_letters,
            self.per_request,
            self.url,
            tuple(self.request_headers().items()),
            self.client,
        )

    def outcome(self, entries: DataFrame, batch_id: int | None = None) -> Outcome:
        """Deliver; how many entries were delivered and failed, and a last error."""
        return deliver(entries, [Branch(self.outlet())], batch_id).outcomes[0]

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        outcome = self.outcome(entries, batch_id)
        if outcome.failed and self.dead_letters is None:
            raise DeliveryError(failure_text(self.outlet(), outcome))


def _loaded(name: str) -> Callable[[], Post]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _all_to_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``value``, addressed to the only outlet."""
    for batch in batches:
        count = batch.num_rows
        one = pa.StructArray.from_arrays(
            [pa.array(np.zeros(count, np.int32)), pa.nulls(count, pa.list_(pa.string()))], names=["outlet", "folder"]
        )
        goes = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32), one)
        origin = pa.nulls(count, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("value"), origin, goes], names=["line", "origin", "goes"])


class _HttpWriter(_Writer):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskReport:
        return super().write(_all_to_one(iterator))

    def commit(self, messages: list) -> None:
        super().commit(messages)
        total = Outcome()
        for message in messages:
            total.add(message.outcomes[0])
        if total.failed and self.outlets[0].dead_letters is None:
            raise DeliveryError(failure_text(self.outlets[0], total))


class _HttpStreamWriter(_StreamWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskReport:
        return super().write(_all_to_one(iterator))


class HttpSource(DataSource):
    """Options: ``url``, ``per_request``, ``max_attempts``, ``base_delay``,
    ``max_delay``, ``dead_letters`` and ``report`` (folders, with their scheme if
    they are not local), ``header.NAME``, ``client`` (``module:function`` that
    opens a poster)."""

    @classmethod
    def name(cls) -> str:
        return "riverlog_http"

    def schema(self) -> str:
        return "value string"

    def _outlet(self) -> HttpOutlet:
        options = self.options
        require(bool(options.get("url")), "riverlog_http: the option url is required")
        retry = RetryPolicy(
            int(options.get("max_attempts", 1)), float(options.get("base_delay", 0.1)), float(options.get("max_delay", 0))
        )
        named = {key: value for key, value in dict(options).items() if key.lower().startswith("header.")}
        headers = request_headers({key[len("header.") :]: value for key, value in named.items()})
        size = int(options.get("per_request", 1))
        require(size >= 1, "riverlog_http: per_request must be at least 1")
        client = _loaded(options["client"]) if options.get("client") else open_client
        dead_letters = options.get("dead_letters")
        return HttpOutlet("http sink", retry, dead_letters, size, options["url"], tuple(headers.items()), client)

    def writer(self, schema, overwrite: bool) -> _HttpWriter:
        require("value" in schema.names, "riverlog_http: a column value with JSON lines is required")
        batch = self.options.get("batch")
        batch = None if batch is None else int(batch)
        return _HttpWriter([self._outlet()], uuid.uuid4().hex, self.options.get("report"), batch)

    def streamWriter(self, schema, overwrite: bool) -> _HttpStreamWriter:  # noqa: N802
        require("value" in schema.names, "riverlog_http: a column value with JSON lines is required")
        return _HttpStreamWriter([self._outlet()], uuid.uuid4().hex, self.options.get("report"))
