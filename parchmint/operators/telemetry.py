"""Counters, distributions and times of runs: series names, sinks, and counts observed while an action runs."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager, nullcontext
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .metrics import SAMPLES

# The names of series.
NAMES = (
    "pipeline.requests.total", "pipeline.success.total", "pipeline.failure.total", "pipeline.latency.ms", "preprocess.latency.ms", "ocr.latency.ms", "extraction.latency.ms",
    "validation.latency.ms", "ocr.success.total", "ocr.failure.total", "ocr.retry.total", "ocr.confidence", "ocr.fallback.total", "pipeline.low_confidence.total", "validation.failure.total", "validation.warning.total",
    "pipeline.review_required.total", "llm.invoked.total", "llm.success.total", "llm.failure.total", "llm.latency.ms",
)


def series(name: str, labels: Mapping[str, str] | None = None) -> str:
    """A name with its labels in order."""
    return name if not labels else f"{name}{{{','.join(f'{k}={v}' for k, v in sorted(labels.items()))}}}"


class Sink(ABC):
    """Where counts and observations go."""

    @abstractmethod
    def increment(self, name: str, value: float = 1.0, labels: Mapping[str, str] | None = None) -> None: ...

    @abstractmethod
    def observe(self, name: str, value: float, labels: Mapping[str, str] | None = None) -> None: ...

    @abstractmethod
    def snapshot(self) -> dict[str, Any]: ...


class NullSink(Sink):
    """Keeps nothing."""

    def increment(self, name: str, value: float = 1.0, labels: Mapping[str, str] | None = None) -> None:
        return None

    def observe(self, name: str, value: float, labels: Mapping[str, str] | None = None) -> None:
        return None

    def snapshot(self) -> dict[str, Any]:
        return {"counters": {}, "distributions": {}}


class MemorySink(Sink):
    """Keeps counters, and the last SAMPLES observations of each series, in the driver."""

    def __init__(self) -> None:
        self.counters: Counter = Counter()
        self.samples: dict[str, deque[float]] = defaultdict(lambda: deque(maxlen=SAMPLES))

    def increment(self, name: str, value: float = 1.0, labels: Mapping[str, str] | None = None) -> None:
        self.counters[series(name, labels)] += value

    def observe(self, name: str, value: float, labels: Mapping[str, str] | None = None) -> None:
        self.samples[series(name, labels)].append(value)

    def snapshot(self) -> dict[str, Any]:
        def told(values: list[float]) -> dict[str, float]:
            at = lambda q: values[round(q * (len(values) - 1))]
            return {"count": float(len(values)), "min": values[0], "max": values[-1], "mean": sum(values) / len(values), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99)}

        return {"counters": dict(self.counters), "distributions": {k: told(sorted(v)) for k, v in self.samples.items() if v}}


@contextmanager
def timed(sink: Sink, name: str, labels: Mapping[str, str] | None = None) -> Iterator[None]:
    """Observe a block's milliseconds, also where it raises."""
    start = time.perf_counter()
    try:
        yield
    finally:
        sink.observe(name, (time.perf_counter() - start) * 1000, labels)


class Watched:
    """A DataFrame whose action counts its rows on the way, without a job of its own.

    counts are conditions by series; sums are columns added up by series.
    """

    def __init__(self, df: DataFrame, counts: Mapping[str, Column], sums: Mapping[str, Column] | None = None) -> None:
        self._series = [*counts, *(sums or {})]
        told = [F.sum(F.coalesce(c.cast("boolean"), F.lit(False)).cast("long")) for c in counts.values()] + [F.sum(c.cast("double")) for c in (sums or {}).values()]
        self._seen = Observation()
        self.df = df.observe(self._seen, *[F.coalesce(x, F.lit(0)).alias(f"s{i}") for i, x in enumerate(told)])

    def settle(self, sink: Sink, run: Callable[[DataFrame], Any], action: str | None = None) -> Any:
        """What `run`, an action over all rows, gives; its counts go to the sink, and its time under `action`, also if it fails."""
        with timed(sink, action) if action else nullcontext():
            out = run(self.df)
        for i, name in enumerate(self._series):
            sink.increment(name, float(self._seen.get[f"s{i}"]))
        return out
