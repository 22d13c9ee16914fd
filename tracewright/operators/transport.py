"""Calls to a model's server from tasks: several in flight, retries with waits, and classes of failures in place of exceptions.

A transport is a function that a task makes once: it takes a request and returns a Reply, or raises Timeout or Unreachable. Nothing of
a reply but its content and usage leaves this module: a failure is one of a few words.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: What a call that gave no content may be counted as.
FAILURES = ("http_429", "http_5xx", "http_4xx", "timeout", "network", "invalid_response")


class Timeout(Exception):
    """The server took too long."""


class Unreachable(Exception):
    """There was no connection, or it broke."""


@dataclass(frozen=True)
class Reply:
    status: int
    body: str = ""
    retry_after: str | None = None


@dataclass(frozen=True)
class Policy:
    """Retries after the first attempt; waits of base_s, doubled each time, or what the server asks for, up to most_s; calls in flight in a task."""

    retries: int = 2
    base_s: float = 0.5
    most_s: float = 10.0
    in_flight: int = 8

    def wait(self, attempt: int, asked: str | None = None) -> float:
        """Seconds before the attempt after number `attempt` (from 0)."""
        try:
            seconds = float(asked) if asked is not None else math.nan
        except ValueError:
            seconds = math.nan
        if not (math.isfinite(seconds) and seconds >= 0):
            seconds = self.base_s * 2**attempt
        return min(seconds, self.most_s)


@dataclass(frozen=True)
class Outcome:
    content: str | None
    usage: str | None
    failure: str | None
    attempts: int
    latency_ms: float


Send = Callable[[str], Reply]


def _content(body: str) -> tuple[str, str] | None:
    """The message and the usage (a JSON object) of a chat completion."""
    try:
        found = json.loads(body)
        content, usage = found["choices"][0]["message"]["content"], found.get("usage")
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None
    return (content, json.dumps(usage if isinstance(usage, dict) else {}, sort_keys=True)) if isinstance(content, str) else None


def _attempt(send: Send, request: str) -> tuple[tuple[str, str] | None, str | None, bool, str | None]:
    """The content, or a failure, whether to try again, and the wait that the server asks for."""
    try:
        reply = send(request)
    except Timeout:
        return None, "timeout", True, None
    except Unreachable:
        return None, "network", True, None
    if reply.status == 429:
        return None, "http_429", True, reply.retry_after
    if 500 <= reply.status < 600:
        return None, "http_5xx", True, reply.retry_after
    if 400 <= reply.status < 500:
        return None, "http_4xx", False, None
    content = _content(reply.body)
    return content, None if content else "invalid_response", False, None


def complete(send: Send, request: str, policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.perf_counter) -> Outcome:
    """One call with its retries. latency_ms includes the waits."""
    began = clock()
    for attempt in range(policy.retries + 1):
        content, failure, again, asked = _attempt(send, request)
        if not again or attempt == policy.retries:
            break
        sleep(policy.wait(attempt, asked))
    return Outcome(*(content or (None, None)), failure, attempt + 1, (clock() - began) * 1000)


class Waits:
    """A clock that only waits move, for tests and for transports without a network."""

    def __init__(self) -> None:
        self.now = 0.0

    def sleep(self, seconds: float) -> None:
        self.now += seconds

    def clock(self) -> float:
        return self.now


ANSWER = "content string, usage string, failure string, attempts int, latency_ms double"


def call_all(requests: DataFrame, connect: Callable[[], Send], policy: Policy = Policy(), real: bool = True) -> DataFrame:
    """requests, but for the column request, with the outcome of each: content, usage, failure, attempts and latency_ms.

    Each task connects once and has up to policy.in_flight calls on their way; rows keep their order, and a batch of rows is in memory at
    a time. `real` is false for transports without a network, whose waits take no time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields if f.name != "request"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = connect()

        def one(request: str) -> Outcome:
            waits = Waits()
            return complete(send, request, policy) if real else complete(send, request, policy, waits.sleep, waits.clock)

        with ThreadPoolExecutor(policy.in_flight) as pool:
            for batch in batches:
                out = list(pool.map(one, batch.column("request").to_pylist()))
                fields = {"content": pa.string(), "usage": pa.string(), "failure": pa.string(), "attempts": pa.int32(), "latency_ms": pa.float64()}
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kinds), *(pa.array([getattr(o, n) for o in out], t) for n, t in fields.items())], [*kinds, *fields])

    return requests.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in kinds.items()), ANSWER]))
