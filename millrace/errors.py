"""Failure handling around sinks: classification, retries, circuit breaker, dead letters, side outputs.

These wrap the driver-side body of a micro-batch (``foreachBatch``); bad rows are split off declaratively.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Category(Enum):
    RETRIABLE = "retriable"
    FATAL = "fatal"
    TRANSIENT = "transient"


# Words in messages that tell a passing failure from a lasting one.
TRANSIENT_WORDS = ("timeout", "timed out", "temporarily", "unavailable", "too many requests", "throttl")
RETRIABLE_WORDS = ("connection refused", "connection reset", "broken pipe", "network", "leader not available", "rebalance")
FATAL_WORDS = ("permission denied", "unauthorized", "forbidden", "invalid", "not found", "schema", "parse", "malformed")


class FatalError(Exception):
    pass


class CircuitOpen(Exception):
    pass


def classify(e: BaseException) -> Category:
    """By type first, then by the message; what isn't known may be tried again. An open circuit isn't tried: it has to rest."""
    if isinstance(e, (CircuitOpen, FatalError, PermissionError, FileNotFoundError, ValueError, TypeError, KeyError)):
        return Category.FATAL
    if isinstance(e, TimeoutError):
        return Category.TRANSIENT
    if isinstance(e, ConnectionError):
        return Category.RETRIABLE
    text = str(e).lower()
    for words, cat in ((TRANSIENT_WORDS, Category.TRANSIENT), (RETRIABLE_WORDS, Category.RETRIABLE), (FATAL_WORDS, Category.FATAL)):
        if any(w in text for w in words):
            return cat
    return Category.RETRIABLE


@dataclass
class Retry:
    retries: int = 3
    first: float = 0.1
    factor: float = 2.0
    most: float = 30.0
    jitter: float = 0.1
    sleep: Callable[[float], None] = time.sleep

    def delay(self, attempt: int) -> float:
        d = min(self.most, self.first * self.factor**attempt)
        return d * (1 + random.uniform(-self.jitter, self.jitter))

    def run(self, fn: Callable, *args, **kw):
        """Up to retries + 1 attempts; a fatal failure isn't tried again."""
        for attempt in range(self.retries + 1):
            try:
                return fn(*args, **kw)
            except Exception as e:
                if attempt == self.retries or classify(e) is Category.FATAL:
                    raise
                self.sleep(self.delay(attempt))


@dataclass
class CircuitBreaker:
    """closed -> open after ``failures`` in a row -> half-open after ``rest`` seconds -> closed after ``successes``."""

    failures: int = 5
    successes: int = 2
    rest: float = 60.0
    probes: int = 1
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    _bad: int = 0
    _good: int = 0
    _since: float = 0.0
    _probing: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def allow(self) -> bool:
        with self._lock:
            if self.state == "open" and self.clock() - self._since >= self.rest:
                self.state, self._good, self._probing = "half_open", 0, 0
            if self.state == "half_open":
                if self._probing >= self.probes:
                    return False
                self._probing += 1
                return True
            return self.state == "closed"

    def success(self) -> None:
        with self._lock:
            self._bad = 0
            if self.state == "half_open":
                self._probing = max(0, self._probing - 1)
                self._good += 1
                if self._good >= self.successes:
                    self.state = "closed"

    def failure(self) -> None:
        with self._lock:
            self._bad += 1
            if self.state == "half_open" or self._bad >= self.failures:
                self.state, self._since, self._bad = "open", self.clock(), 0

    def run(self, fn: Callable, *args, **kw):
        if not self.allow():
            raise CircuitOpen("the circuit is open")
        try:
            out = fn(*args, **kw)
        except Exception:
            self.failure()
            raise
        self.success()
        return out


class DeadLetters:
    """Where failed batches and rows go: a folder of JSON (any store Spark writes), memory (whole batches, so for small ones), or nowhere."""

    def __init__(self, path: str | None = None, keep: bool = False):
        self.path, self.keep, self.rows = path, keep, []

    def put(self, batch: DataFrame, error: BaseException, operator: str, retries: int = 0) -> None:
        out = batch.select(F.to_json(F.struct("*")).alias("value")).withColumns({
            "failure_reason": F.lit(str(error)[:1000]), "failure_category": F.lit(classify(error).value), "operator_name": F.lit(operator),
            "failure_time": F.current_timestamp(), "retry_count": F.lit(retries),
        })
        if self.path:
            out.write.mode("append").json(self.path)
        elif self.keep:
            self.rows += [r.asDict() for r in out.collect()]


@dataclass
class SinkPolicy:
    """How a micro-batch is written: fail_fast, retry, dead_letter, or retry_then_dead_letter."""

    strategy: str = "retry_then_dead_letter"
    retry: Retry = field(default_factory=Retry)
    breaker: CircuitBreaker | None = None
    dead: DeadLetters | None = None

    def wrap(self, write: Callable[[DataFrame, int], None], name: str = "sink") -> Callable[[DataFrame, int], None]:
        def guarded(batch: DataFrame, n: int) -> None:
            self.breaker.run(write, batch, n) if self.breaker else write(batch, n)

        def body(batch: DataFrame, n: int) -> None:
            try:
                self.retry.run(guarded, batch, n) if "retry" in self.strategy else guarded(batch, n)
            except Exception as e:
                if "dead_letter" not in self.strategy or self.dead is None:
                    raise
                self.dead.put(batch, e, name, self.retry.retries if "retry" in self.strategy else 0)

        return body


class OnceSink:
    """Skips batches already written, by the identifier Spark repeats after a restart: exactly once with any store
    that keeps ``done`` and the data together, here a folder a batch that is overwritten as a whole."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={n}")


def split_errors(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that meet all conditions, and the others with the names of those they don't meet."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    out = df.withColumn("failures", failed)
    return out.where(F.size("failures") == 0).drop("failures"), out.where(F.size("failures") > 0)


def side_outputs(df: DataFrame, main: Column, **named: Column) -> dict[str, DataFrame]:
    return {"main": df.where(main), **{n: df.where(c) for n, c in named.items()}}
