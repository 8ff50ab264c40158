"""Retries with exponential delay, and JSON events."""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import random
import sys
import time
import uuid


class RateLimited(Exception):
    status = 429

    def __init__(self, message="rate limited", retry_after_ms: float | None = None):
        super().__init__(message)
        self.retry_after_ms = retry_after_ms


def default_retryable(error: Exception) -> bool:
    return getattr(error, "status", None) == 429 or isinstance(error, (TypeError, ConnectionError))


def retry_with_backoff(call, *, max_retries=3, base_delay_ms=1000.0, max_delay_ms=float("inf"), jitter=0.0, is_retryable=default_retryable, retry_after=lambda e: getattr(e, "retry_after_ms", None), on_retry=None, sleep=None, rng=random.random):
    """``call(attempt)``, again after base * 2^attempt or the hinted delay, jittered, then capped."""
    for attempt in range(max_retries + 1):
        try:
            return call(attempt)
        except Exception as error:
            if attempt >= max_retries or not is_retryable(error):
                raise
            hint = retry_after(error)
            delay = hint if hint is not None and abs(hint) != float("inf") and hint == hint else base_delay_ms * 2**attempt
            if jitter > 0:
                delay *= 1 + (rng() - 0.5) * 2 * jitter
            delay = min(delay, max_delay_ms)
            if on_retry:
                on_retry(attempt + 1, delay, error)
            (sleep or time.sleep)(delay / 1000)
    raise AssertionError("not reached")


SESSION = uuid.uuid4().hex[:16]


class EventLog:
    """JSON lines on standard error, if the environment's ``variable`` is set or ``enabled`` says so.

    With ``domains`` only events of those are written; an event's domain stands before its first dot.
    """

    def __init__(self, enabled: bool | None = None, stream=None, *, domains=None, variable: str = "CORVANE_LOG", **context):
        self.enabled = bool(os.environ.get(variable)) if enabled is None else enabled
        self.stream, self.context, self.domains, self.session_id = stream or sys.stderr, context, domains and set(domains), SESSION

    def correlate(self, **fields) -> None:
        """Fields that all events carry from now on; ``session_id`` replaces the process's own."""
        self.session_id = fields.pop("session_id", self.session_id)
        self.context = {**self.context, **fields}

    def event(self, name: str, **fields) -> None:
        domain, dot, _ = name.partition(".")
        if not self.enabled or self.domains is not None and not (dot and domain in self.domains):
            return
        now = datetime.datetime.now(datetime.UTC).isoformat()
        print(json.dumps({"ts": now, "event": name, "session_id": self.session_id, **self.context, **fields}, default=str), file=self.stream)

    @contextlib.contextmanager
    def timing(self, name: str, **fields):
        """Around a block, which may await: one event with its duration, and its error if it raises one."""
        began = time.perf_counter()
        error = {}
        try:
            yield
        except BaseException as raised:
            error = {"error.type": type(raised).__name__, "error.message": str(raised)}
            raise
        finally:
            self.event(name, duration_ms=round((time.perf_counter() - began) * 1000), **fields, **error)
