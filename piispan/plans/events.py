"""Driver-side hooks around the stages of a plan, and small helpers.

A plan is lazy, so stage events tell when a stage's plan is built; `observed` carries a stage's counts out of the running query.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from piispan.operators.telemetry import EVENTS

log = logging.getLogger(__name__)
MAX_CHARS, CUT_MARK = 100_000, "... [truncated]"


class Bus:
    """Handlers by event; a handler that fails is logged, and the others run."""

    def __init__(self):
        self.handlers: dict[str, list[Callable[[str, Any], None]]] = {}

    def subscribe(self, event: str, handler: Callable[[str, Any], None]) -> None:
        if event not in EVENTS:
            raise ValueError(f"no event {event}")
        self.handlers.setdefault(event, []).append(handler)

    def unsubscribe(self, event: str, handler: Callable[[str, Any], None]) -> None:
        """Takes out the handler's first subscription, if there is one."""
        if handler in self.handlers.get(event, []):
            self.handlers[event].remove(handler)

    def emit(self, event: str, data: Any = None) -> None:
        for handler in list(self.handlers.get(event, [])):
            try:
                handler(event, data)
            except Exception:
                log.exception("a handler of %s failed", event)

    @contextmanager
    def stage(self, name: str, data: Any = None):
        self.emit(f"before_{name}", data)
        try:
            yield
        except Exception:
            self.emit("pipeline_error", data)
            raise
        self.emit(f"after_{name}", data)


class NoBus(Bus):
    def subscribe(self, event, handler) -> None: ...

    def emit(self, event, data=None) -> None: ...


def observed(docs: DataFrame, name: str = "pii") -> tuple[DataFrame, Observation]:
    """Counts of documents, spans and blocked documents, gathered while the query runs."""
    o = Observation(name)
    blocked = F.sum(F.col("blocked").cast("int")) if "blocked" in docs.columns else F.lit(0)
    return docs.observe(o, F.count(F.lit(1)).alias("documents"), F.sum(F.size("spans")).alias("spans"), blocked.alias("blocked")), o


def truncated(text: Column, most: int = MAX_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(CUT_MARK))).otherwise(text)


def config_hash(settings: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


@contextmanager
def timed(sink: list[float]):
    began = time.perf_counter()
    yield
    sink.append(time.perf_counter() - began)
