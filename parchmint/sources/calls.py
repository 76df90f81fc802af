"""Calls of recognition providers inside tasks: tries, waits, a second provider, and outcomes as rows.

A provider gets a request (a dict of the row's columns) and returns lines, or raises Failure with a code.
Nothing that it raises fails a job: every request has one row, with its lines or with its error.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from parchmint.operators.failures import LONGEST_WAIT
from parchmint.operators.gates import FALLBACK, RETRYABLE

Provider = Callable[[dict[str, Any]], list[dict[str, Any]]]
LINES = "array<struct<text:string,confidence:double,bbox:array<int>>>"
OUTCOME = f"lines {LINES}, error string, attempts int, waited_ms double, served_by string, first_error string"
_LINE = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.int32()))])
_ARROW = {"lines": pa.list_(_LINE), "error": pa.string(), "attempts": pa.int32(), "waited_ms": pa.float64(), "served_by": pa.string(), "first_error": pa.string()}
_KNOWN: dict[str, Provider] = {}


class Failure(Exception):
    """A failure with its code; any other exception of a provider is an INTERNAL_ERROR and never tried again."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


@dataclass
class Outcome:
    lines: list[dict[str, Any]] | None = None
    error: str | None = None
    attempts: int = 0
    waited_ms: float = 0.0
    served_by: str | None = None
    first_error: str | None = None


@dataclass(frozen=True)
class Policy:
    """Up to max_retries more tries than one, each after a wait drawn evenly below a ceiling that doubles.

    The draw depends on seed, the request's key and the try, so a task that is run again waits as long.
    """

    max_retries: int = 2
    base: float = 0.5
    seed: int = 0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def wait(self, key: object, attempt: int) -> float:
        return random.Random(f"{self.seed}:{key}:{attempt}").uniform(0.0, min(LONGEST_WAIT, self.base * 2**attempt))


def called(name: str, provider: Provider, request: dict[str, Any], key: object, policy: Policy) -> Outcome:
    """One provider's outcome: an empty answer is a failure too."""
    out = Outcome()
    for attempt in range(policy.max_retries + 1):
        out.attempts += 1
        try:
            if out_lines := provider(request):
                return Outcome(out_lines, None, out.attempts, out.waited_ms, name)
            out.error = "OCR_EMPTY_RESULT"
        except Failure as failure:
            out.error = failure.code
        except Exception:
            out.error = "INTERNAL_ERROR"
        if out.error not in RETRYABLE or attempt == policy.max_retries:
            return out
        wait = policy.wait(key, attempt)
        policy.sleep(wait)
        out.waited_ms += wait * 1000
    return out


def served(chain: list[tuple[str, Provider]], request: dict[str, Any], key: object, policy: Policy) -> Outcome:
    """The first provider's outcome, or the next one's where the failure says something of the provider and not of the document."""
    before = Outcome()
    for i, (name, provider) in enumerate(chain):
        out = called(name, provider, request, key, policy)
        out.attempts += before.attempts
        out.waited_ms += before.waited_ms
        out.first_error = before.first_error if i else None
        if out.error is None or out.error not in FALLBACK:
            return out
        before = Outcome(attempts=out.attempts, waited_ms=out.waited_ms, first_error=before.first_error if i else out.error)
    return out


def register(name: str, provider: Provider) -> None:
    """Make a provider known by its lower-cased name."""
    _KNOWN[name.lower()] = provider


def chain(name: str) -> list[tuple[str, Provider]]:
    """The providers of "a" or "a+b"; an unknown name says which are known.

    A name with a colon is one of a module, as in "package.module:function", which workers import themselves:
    a data source is planned in a process of its own, where nothing that the driver registered is known.
    """
    found = []
    for part in name.split("+"):
        module, colon, attribute = part.partition(":")
        if not colon and part.lower() not in _KNOWN:
            raise KeyError(f"PROVIDER_NOT_REGISTERED: {part}; known: {', '.join(sorted(_KNOWN))}")
        found.append((part, getattr(importlib.import_module(module), attribute)) if colon else (part.lower(), _KNOWN[part.lower()]))
    return found


def _columns(outcomes: Iterable[Outcome]) -> list[pa.Array]:
    rows = list(outcomes)
    return [pa.array([getattr(o, c) for o in rows], kind) for c, kind in _ARROW.items()]


def recognised(requests: DataFrame, providers: list[tuple[str, Provider]], key: str = "doc_id", policy: Policy = Policy()) -> DataFrame:
    """requests with the columns of OUTCOME, which each row's call in its task gave. One row in, one row out.

    A task that is run again calls again: providers see a request at least once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _columns(served(providers, row, row[key], policy) for row in batch.to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *_ARROW])

    return requests.mapInArrow(run, StructType([*requests.schema.fields, *StructType.fromDDL(OUTCOME).fields]))


@dataclass
class Span(InputPartition):
    """Documents first .. last of a data source."""

    first: int
    last: int


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.first, self.last = int(options["first"]), int(options["last"])
        self.parts = max(1, int(options.get("partitions", "8")))
        self.providers = chain(options["provider"])
        self.policy = Policy(int(options.get("max_retries", "2")), float(options.get("base_delay", "0.5")), int(options.get("seed", "0")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on doc_id narrow the span, so that no call is made for other documents."""
        for f in filters:
            bound = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if bound is None or f.attribute != ("doc_id",):
                yield f
                continue
            low, high = bound
            self.first = self.first if low is None else max(self.first, f.value + low)
            self.last = self.last if high is None else min(self.last, f.value + high)

    def partitions(self) -> list[InputPartition]:
        n = max(0, self.last - self.first + 1)
        cuts = [self.first + n * i // self.parts for i in range(self.parts + 1)]
        return [Span(a, b - 1) for a, b in zip(cuts, cuts[1:]) if a < b]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        step = 1000
        for at in range(partition.first, partition.last + 1, step):
            ids = range(at, min(partition.last, at + step - 1) + 1)
            made = _columns(served(self.providers, {"doc_id": i}, i, self.policy) for i in ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *made], ["doc_id", *_ARROW])


class ProviderSource(DataSource):
    """spark.read.format("parchmint_provider"): documents `first` to `last` of a `provider` ("package.module:function", or two with a plus), one row each.

    A document that no provider reads has a row with its error. Reads go by partitions of ids. The session
    needs spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls) -> str:
        return "parchmint_provider"

    def schema(self) -> str:
        return f"doc_id long, {OUTCOME}"

    def reader(self, schema: StructType) -> ProviderReader:
        return ProviderReader({k.lower(): v for k, v in self.options.items()})
