"""Failures as columns: their HTTP status, which are tried again and which go to another provider."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gates import FALLBACK, RETRYABLE

# The status of each code that is not 500, and the longest wait before another try.
STATUS = {
    "INVALID_IMAGE": 400, "EMPTY_FILE": 400, "UNSAFE_FILENAME": 400, "UNSUPPORTED_FILE_TYPE": 415, "IMAGE_TOO_LARGE": 413, "IMAGE_TOO_SMALL": 422,
    "OCR_FAILED": 502, "OCR_EMPTY_RESULT": 502, "OCR_TIMEOUT": 504, "PROVIDER_UNAVAILABLE": 503, "LLM_FAILED": 502, "LLM_INVALID_OUTPUT": 502,
    "LLM_TIMEOUT": 502, "PROVIDER_QUOTA_EXHAUSTED": 502, "LLM_UNAVAILABLE": 503, "UNAUTHORIZED": 401, "REQUEST_TOO_LARGE": 413, "RATE_LIMITED": 429,
}
LONGEST_WAIT = 8.0


#: All codes, those with status 500 last.
CODES = (*STATUS, "PROVIDER_NOT_REGISTERED", "EXTRACTION_FAILED", "INVALID_RECEIPT", "INTERNAL_ERROR")


def status(code: Column) -> Column:
    """The HTTP status of a failure's code, 500 for any other; null for none."""
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(known, code), F.lit(500)))


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def longest_wait(attempt: Column, base: float = 0.5) -> Column:
    """Seconds that a wait before try `attempt` + 1 may take at most; the wait is drawn below it."""
    return F.least(F.lit(LONGEST_WAIT), F.lit(base) * F.pow(F.lit(2.0), attempt))


def attempted(codes: Column, max_retries: int) -> Column:
    """struct<attempts, code> of a call whose tries would end with codes in turn (null: success).

    It ends with the first success, with the first failure that no other try can mend, and after
    max_retries more tries than one. No codes at all: no attempt.
    """
    ends = F.transform(codes, lambda c, i: F.when(c.isNull() | ~c.isin(*RETRYABLE) | (i >= max_retries), i))
    last = F.coalesce(F.array_min(ends), F.size(codes) - 1)
    return F.struct((last + 1).cast("long").alias("attempts"), F.get(codes, last).alias("code"))


def served(first: Column, second: Column) -> Column:
    """struct<by, code>: the second provider is asked only where the first failed in a way of its own.

    A document that fails with both keeps the second's code.
    """
    asked = first.isin(*FALLBACK)
    by = F.when(first.isNull(), "first").when(asked & second.isNull(), "second")
    return F.struct(by.alias("by"), F.when(asked, second).otherwise(first).alias("code"))
