"""Periodic runs of words, by Karp-Miller-Rosenberg names of power-of-two stretches.

Stretches of 2^k words get a number each, equal for equal stretches of one document, by naming pairs of
numbers of the level below. How far two places agree (their LCE) is then read off by descending levels.
For each period q places are taken on a grid; those whose next 2^k words, about q of them, come again q
words later are extended both ways. Names are exact, so nothing is hashed and no suffixes are sorted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import distinct_names, raw_text

#: Words that are named together, unless one document has more; pairs of places that are looked at together.
TOGETHER, PAIRS = 1 << 17, 1 << 20
#: Bytes of all levels' names of a document; beyond them the highest level is applied repeatedly.
NAME_BYTES = 256 << 20


def name_levels(words: np.ndarray) -> tuple[list[np.ndarray], bool]:
    """Each level's names, and whether nothing repeats on a higher level. Level k's names are equal and not negative at two places if the 2^k words from there are equal; negative where they are found once.

    words hold numbers, unlike ones in unlike documents. Only places whose two halves are both found again are
    named anew, so the work falls with the levels; it ends with the level at which nothing repeats.
    """
    n = len(words)
    levels: list[np.ndarray] = []
    most = max(8, NAME_BYTES // (4 * n + 4))
    once = -1 - np.arange(n + 1, dtype=np.int32)  # a place after the last word, unlike all
    places, keys = np.arange(n), words.astype(np.int64)
    while len(levels) < most:
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = times[which] > 1
        if not again.any():
            return levels, True
        names = once.copy()
        names[places[again]] = which[again]
        levels.append(names)
        step = 1 << (len(levels) - 1)
        places = places[again]
        places = places[places + step <= n]
        after = names[places + step]
        places, after = places[after >= 0], after[after >= 0]
        keys = (names[places].astype(np.int64) << 32) | after
    return levels, False


def _agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from places a and b on, or before them."""
    total = np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    live = np.arange(len(a))
    for k in range(len(levels) - 1, -1, -1):
        names, step, live = levels[k], 1 << k, np.arange(len(a))
        while len(live):
            x, y = (a[live] + total[live], b[live] + total[live]) if forward else (a[live] - total[live] - step, b[live] - total[live] - step)
            at = names[np.clip(x, 0, last)]
            same = (at == names[np.clip(y, 0, last)]) & (at >= 0) & (x >= 0) & (x != y)
            live = live[same]
            total[live] += step
            if k < len(levels) - 1:
                break
    return total


def _grid(levels: list[np.ndarray], whole: bool, n: int, most: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, period) on the grid whose stretch comes again a period later, in parts.

    A run of `times` periods or more has s = (times - 1) q places in a row that come again q later, so some place
    of a grid of s + 1 - 2^k has 2^k of them from it on; k is such that 2^k is about half of s. Periods whose
    stretch is longer than anything that repeats have no run.
    """
    periods = np.arange(1, most + 1)
    row = (times - 1) * periods
    high = np.log2((row + 1) / 2).astype(np.int64)
    if whole:
        periods, row, high = (x[high < len(levels)] for x in (periods, row, high))
    high = np.minimum(high, len(levels) - 1)
    steps = row + 1 - (1 << high)
    many = np.maximum(0, -((periods - n) // steps))  # places 0, step, 2 step .. below n - q
    ends = np.cumsum(many)
    at = 0
    while at < len(periods):
        base = ends[at] - many[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        own, starts = many[at:stop], (ends[at:stop] - many[at:stop] - base)
        q, k, step = (np.repeat(x[at:stop], own) for x in (periods, high, steps))
        place = (np.arange(len(q)) - np.repeat(starts, own)) * step
        for level in np.unique(k).tolist():
            mine = k == level if k[0] != k[-1] else slice(None)
            names = levels[level]
            here, period = place[mine], q[mine]
            x = names[here]
            found = (x >= 0) & (x == names[here + period])
            yield here[found], period[found]
        at = stop


def find_runs(words: np.ndarray, most: int, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, smallest period), by start and period, of all runs in words with at most `most` words a period.

    A run cannot be extended, is at least `least` words and `times` periods (two at least) long.
    """
    none = np.empty((0, 3), np.int64)
    if times < 2 or least <= times:
        raise ValueError("runs need two periods at least, and more words than periods")
    levels, whole = name_levels(words)
    if not levels or most < 1:
        return none
    found = [none]
    for place, period in _grid(levels, whole, len(words), most, times):
        if len(place):
            before = _agree(levels, place, place + period, False)
            length = before + _agree(levels, place, place + period, True) + period
            enough = length >= np.maximum(least, times * period)
            made = np.stack([place - before, length, period], axis=1)[enough]
            _, one = np.unique(made[:, 0] << 31 | made[:, 2], return_index=True)  # place and period tell the length
            found.append(made[one])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # a run of a multiple of its period has the same place and length
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """find_runs for each list of words; short lists are named together, each with numbers of its own."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    order = np.argsort(sizes, kind="stable")  # alike lengths together: the longest decides how many periods are tried
    order = order[sizes[order] >= least]
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        base = ends[at] - sizes[order[at]]
        stop = max(at + 1, int(np.searchsorted(ends, base + TOGETHER, "right")))
        own = order[at:stop]
        offsets = np.concatenate([[0], np.cumsum(sizes[own])])
        flat = np.empty(offsets[-1], np.int64)
        first = 0
        for j, i in enumerate(own.tolist()):
            number = defaultdict(count(first).__next__)
            flat[offsets[j] : offsets[j + 1]] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, sizes[i])
            first += len(number)
        runs = find_runs(flat, int(sizes[own].max()) // times, least, times)
        cuts = np.searchsorted(runs[:, 0], offsets)
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            mine = runs[cuts[j] : cuts[j + 1]].copy()
            mine[:, 0] -= offsets[j]
            out[own[j]] = mine
        at = stop
    return out


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(mark[:-1]) == 0


def _collapsed(at: int, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            texts = [raw_text(t).split() for t in batch.column(at)]
            found = runs_of_texts(texts, least, times)
            kept = [b" ".join([w for w, k in zip(t, without_repeats(len(t), r).tolist()) if k] if len(r) else t) for t, r in zip(texts, found)]
            flat = np.concatenate([*found, np.empty((0, 3), np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], fields=list(kind)))
            made = [pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [f"c{i}" for i in range(batch.num_columns + 3)])

    return run


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """All columns of docs, and n_words, runs (array of start, length, period by start and period) and collapsed.

    Words split at ASCII white space. A run is a stretch of words of smallest period q, at least `least` words
    and `times` periods long, that cannot be extended; collapsed has the words, joined by one space, that no
    run contains after its first q. Null and empty texts have no words, no runs and collapse to the empty
    text; a text is read whole, however long. Rows are judged one by one, so repeated rows, null ids and ties
    make no difference; an empty table gives an empty table. New columns get underscores before their names
    where docs has such columns. Nothing is shuffled.

    Names of a document take 4 bytes a word and level, at most NAME_BYTES in all or eight levels; a run that
    overlaps others is reported by itself.
    """
    words, runs, text = distinct_names(docs.columns, "n_words", "runs", "collapsed")
    run = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
    schema = StructType([*docs.schema.fields, StructField(words, LongType()), StructField(runs, ArrayType(run)), StructField(text, StringType())])
    return docs.mapInArrow(_collapsed(docs.columns.index(text_col), least, times), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of several the first by start, then period. Null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_planted_periods(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs where the words of every tenth text (by the checksum of its id) go on periodically from some word on.

    h is the CRC-32 of the decimal id and g = h // 10. If h % 10 is 0 and there are n > 0 words, word i >= a is
    word a + (i - a) % p with a = g % n and p = 1 + (n - a) // (3 + g % 8). Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    made = F.transform(F.array(words), planted)[0]
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.coalesce(made, F.col(text_col))).otherwise(F.col(text_col)))
