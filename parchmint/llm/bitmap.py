"""A filter of fixed size over 64-bit keys: what it passes is a superset, so exact joins may follow it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 16 MB whatever the number of keys; a full filter passes everything.
BITS = 27


def key_bitmaps(keys: DataFrame, column: str, kinds: list[Column], bits: int = BITS) -> list[np.ndarray]:
    """Bytes of a bitmap for each of the conditions in kinds, in which the low bits of each key that meets it are set.

    All are built in one job by partial aggregates, 4 KB a group.
    """
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(at.alias("_at"), F.posexplode(F.array(*kinds)).alias("_kind", "_met")).where("_met")
    rows = rows.groupBy("_kind", F.shiftright("_at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in kinds]
    for r in rows:
        out[r["_kind"]][r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def key_bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bytes of a bitmap in which each key's low bits are set."""
    return key_bitmaps(keys, column, [F.lit(True)], bits)[0]


def bits_for(keys: int, least: int = 17, most: int = 30) -> int:
    """Bits of a filter that so many keys leave nearly empty, one of 16 set: 16 MB for 8 million keys, 128 MB at most."""
    return min(most, max(least, (16 * max(1, keys) - 1).bit_length()))


def maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the bitmap."""
    at = (keys & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_by(bitmap: np.ndarray, wanted: bool):
    """Rows, for mapInArrow, whose last column, a 64-bit key, may be in the bitmap; or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64)
            yield batch.filter(pa.array(maybe(bitmap, keys) == wanted))

    return run
