"""Substring deduplication by a log-structured index of window hashes.

The hash of a window of 50 words is the least hash of its 8-word shingles: equal windows have equal
hashes, and neighbouring windows mostly share one, so a document has a run of windows (a block) for
each of a few hashes. The index holds blocks, each content once with the smallest document that has
it, in sorted immutable runs. A batch becomes a run, is merge-joined with the older ones, and is
verified: blocks by 128-bit digests of their words, and where blocks of one hash differ, their single
windows by what the runs hold of each. Texts of earlier batches are not read again. Runs are compacted
by levels, and a manifest names them, so an index is opened again later and elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import BITS, bits_for, key_bitmap, key_bitmaps, maybe, split_by
from .common import distinct_names, exists, raw_text, release, remove, saved, scratch_path, small_batches

SHINGLE = 8
#: Rows that a worker holds before it hands them on.
ROWS = 10_000
#: What a worker tells of blocks.
BLOCK = "hash long, digest binary, low long, high long, windows binary"
#: Bytes of text for each bucket of a run; documents of a batch that are sampled for hot hashes, and how many of these a run may have.
BUCKET_BYTES, SAMPLED, HOT = 24 << 20, 800, 256
#: Buckets of a run at most, and bytes that its writer holds.
BUCKETS, HELD = 1 << 15, 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between calls up to a bounded length."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n2 = max(n, 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n2 - 1, x, np.uint64)])) for x in (_BASE, inverse)]
        if n2 > 1 << 20:
            return made[0], made[1]
        _POWERS, _INVERSE = made
    return _POWERS, _INVERSE


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _mixed(g: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        g = (g ^ (g >> np.uint64(shift))) * np.uint64(factor)
    return g ^ (g >> np.uint64(32))


def window_hashes(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` words the least hash of its shingles, and a hash of its own; fewer words have none."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    k = min(SHINGLE, width)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[:n], dtype=np.uint64)])
    shingles = _mixed((sums[k:] - sums[:-k]) * up[: n - k + 1])
    return sliding_min(shingles, width - k + 1), _mixed((sums[width:] - sums[:-width]) * up[: n - width + 1])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]) if len(x) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(x)]]))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _handed_on(out: list[list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds.values())], list(kinds))
    for values in out:
        values.clear()
    return made


def _cut_up(raw: bytes, width: int, known: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, bytes]:
    """A text's blocks, or those whose hash may be known: hashes, digests, first windows, numbers of windows; and all windows' hashes."""
    words = raw.split()
    x, own = window_hashes(words, width)
    starts, lengths = _runs(x)
    if known is not None and len(starts):
        keep = maybe(known, x[starts])
        starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.empty(0, np.int64), [], starts, lengths, b""
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    froms, tos = begins[starts].tolist(), (ends[starts + lengths + width - 2] - 1).tolist()
    return x[starts].view(np.int64), [_digest(flat[a:b]) for a, b in zip(froms, tos)], starts, lengths, own.tobytes()


def _blocks(width: int, windowed: bool = True):
    """(hash, digest, low, high, windows) of the blocks of (doc, text), equal ones of ROWS together; windows is null unless windowed."""
    kinds = {"hash": pa.int64(), "digest": pa.binary(), "low": pa.int64(), "high": pa.int64(), "windows": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes, digests, starts, lengths, own = _cut_up(raw_text(text), width)
                for h, d, a, n in zip(hashes.tolist(), digests, starts.tolist(), lengths.tolist()):
                    if (seen := held.get(d)) is None:
                        held[d] = [h, d, doc, doc, own[8 * a : 8 * (a + n)] if windowed else None]
                    else:
                        seen[2], seen[3] = min(seen[2], doc), max(seen[3], doc)
                if len(held) >= ROWS:
                    yield out()
        yield out()

    return run


def _places(width: int, known: np.ndarray, many: np.ndarray):
    """The blocks of (doc, text) whose hash may be known, with their place, and with their windows' hashes where blocks of that hash may differ."""
    kinds = {"hash": pa.int64(), "digest": pa.binary(), "doc": pa.int64(), "windows": pa.binary(), "row": pa.int64(), "start": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in kinds]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw_text(text)
                hashes, digests, starts, lengths, own = _cut_up(raw, width, known)
                if not digests:
                    continue
                told = maybe(many, hashes.view(np.uint64)).tolist()
                row = xxhash.xxh64_intdigest(raw, 42)
                row -= (row >> 63) << 64
                starts, lengths = starts.tolist(), lengths.tolist()
                windows = [own[8 * a : 8 * (a + n)] if t else None for a, n, t in zip(starts, lengths, told)]
                for values, new in zip(out, (hashes.tolist(), digests, [doc] * len(starts), windows, [row] * len(starts), starts, lengths)):
                    values += new
                if len(out[0]) >= ROWS:
                    yield _handed_on(out, kinds)
        yield _handed_on(out, kinds)

    return run


def _unfolded(many: np.ndarray | None):
    """A row for each window of blocks (windows, hash, others) whose hash may be in many: hash, others, the window's own hash and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if many is not None:
                batch = batch.filter(pa.array(maybe(many, np.asarray(batch.column(1)).view(np.uint64))))
            raw = [w.as_buffer().to_pybytes() for w in batch.column(0)]
            n = np.fromiter((len(w) // 8 for w in raw), np.int64, len(raw))
            own = np.frombuffer(b"".join(raw), np.int64)
            take = pa.array(np.repeat(np.arange(len(raw)), n))
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns[1:]], pa.array(own), pa.array(place)], [*batch.schema.names[1:], "own", "place"])

    return run


def buckets_for(size: int) -> int:
    """Buckets for so many bytes of text: one for BUCKET_BYTES, so that a task that writes or reads one stays small."""
    return min(BUCKETS, max(1, -(-size // BUCKET_BYTES)))


class WindowIndex:
    """Sorted immutable runs of (slot, hash, digest, low, high, windows): each block once, with the smallest and largest document of it.

    A run is a table bucketed and sorted by slot, so merge joins read it without a shuffle. The slot is the
    hash; where a sample of the batch shows a hash in a fiftieth of its documents or more (a passage that
    differs in what surrounds it), its blocks are spread by their digests, and the hash is kept in the list of
    the run's hot ones, HOT at most. More than `fan` runs of a level become one of the next, by one shuffle. Runs and
    the manifest that names them lie under path, in the shared folder; an index there is opened again, by
    any later session. Without a path the index is scratch, has no manifest, and close() removes it.

    The first batch's bytes decide how many buckets there are, if they are not given.
    """

    SCHEMA = "slot long, hash long, digest binary, low long, high long, windows binary"

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = 50, buckets: int | None = None, fan: int = 4) -> None:
        self.spark, self.width, self.fan, self.scratch, self.buckets = spark, width, fan, path is None, buckets
        self.path = path or scratch_path(spark, "index")
        self.runs: list[tuple[str, int, tuple[int, ...]]] = []
        self.version = 0
        if not self.scratch and exists(spark, f"{self.path}/manifest"):
            rows = spark.read.parquet(f"{self.path}/manifest")
            last = rows.orderBy("version", ascending=False).first()
            self.version, self.width, self.buckets = last["version"], last["width"], last["buckets"]
            self.runs = [(r["run"], r["level"], tuple(r["hot"])) for r in rows.where(F.col("version") == self.version).orderBy("place").collect() if r["run"]]
            for run, *_ in self.runs:
                columns = self.SCHEMA.replace("long", "BIGINT").replace("binary", "BINARY")
                spark.sql(f"CREATE TABLE IF NOT EXISTS {run} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")

    def _write(self, blocks: DataFrame, hot: tuple[int, ...]) -> str:
        name = f"parchmint_run_{uuid.uuid4().hex[:12]}"
        slot = F.when(F.col("hash").isin(*hot), F.xxhash64("digest")).otherwise(F.col("hash")) if hot else F.col("hash")
        dealt = blocks.select(slot.alias("slot"), "hash", "digest", "low", "high", "windows").repartition(self.buckets, "slot")
        # blocks of one slot lie together, so grouping moves none a second time
        rows = dealt.groupBy("slot", "hash", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("windows").alias("windows"))
        rows.write.bucketBy(self.buckets, "slot").sortBy("slot").option("parquet.block.size", HELD).option("path", f"{self.path}/{name}").saveAsTable(name)
        release(self.spark)  # all windows were in that shuffle
        return name

    def _note(self, runs: list[tuple[str, int, tuple[int, ...]]]) -> None:
        """A new version of the manifest; runs that it does not name go."""
        self.version += 1
        if not self.scratch:
            rows = [(self.version, i, run, level, list(hot), self.width, self.buckets) for i, (run, level, hot) in enumerate(runs or [("", 0, ())])]
            kind = "version int, place int, run string, level int, hot array<long>, width int, buckets int"
            self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for run, *_ in set(self.runs) - set(runs):
            self.spark.sql(f"DROP TABLE {run}")
            remove(self.spark, f"{self.path}/{run}")
        self.runs = runs

    def _hot(self, docs: DataFrame, n: int) -> tuple[int, ...]:
        """Hashes of blocks that a fiftieth of a sample of documents have; what is missed costs balance only."""
        sample = docs.sample(min(1.0, SAMPLED / max(1, n)), seed=5)
        seen = sample.mapInArrow(_blocks(self.width), BLOCK).groupBy("hash").agg(F.count("*").alias("k"), F.countDistinct("digest").alias("unlike"))
        least = max(16, min(n, SAMPLED) // 50)
        return tuple(r["hash"] for r in seen.where((F.col("k") >= least) & (F.col("unlike") > 1)).orderBy(F.desc("k"), "hash").limit(HOT).collect())

    def _related(self, own: DataFrame, hot: tuple[int, ...]) -> list[DataFrame]:
        """Blocks of older runs with a hash that this run has, by merge joins of sorted runs; hashes that are hot on either side by list."""
        cold = own.where("slot = hash").select("slot").distinct().hint("merge")
        both = {h for _, _, old in self.runs for h in old}
        met = [r["hash"] for r in own.where(F.col("hash").isin(*both)).select("hash").distinct().collect()] if both else []
        out = []
        for name, _, old in self.runs:
            table = self.spark.table(name)
            out.append(table.join(cold, "slot", "left_semi"))
            listed = [*(set(met) & set(old)), *hot]
            if listed:  # what the merge join has found is not taken again
                known = F.col("hash").isin(*listed) & ((F.col("slot") != F.col("hash")) | F.col("hash").isin(*hot) if hot else F.col("slot") != F.col("hash"))
                out.append(table.where(known).join(cold, "slot", "left_anti"))
        return [x.select("hash", "digest", "low", "high", "windows") for x in out]

    def add(self, docs: DataFrame, n: int | None = None, size: int | None = None, last: bool = False) -> DataFrame:
        """Take a batch (doc, text) in; returns (doc, row, start, n): windows start .. start + n - 1 of its
        texts that a document with a smaller id has too, in the batch or before.

        Earlier batches are judged no more. A block whose digest a smaller document has is repeated
        whole; the others of a hash with several digests are compared window by window, by 64 bits of the
        window's own hash under the 64 bits of the block's. n and size are the batch's documents and bytes, if known.
        After the last batch none may follow: its run holds no windows, which are most of a run, as only later
        batches would read them there; its own come from its texts, for hashes with several digests alone.
        """
        if n is None or (size is None and self.buckets is None):
            told = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
            n, size = told["n"], told["size"]
        self.buckets = self.buckets or buckets_for(size)
        passing: list[str] = []

        def kept_for_now(df: DataFrame, name: str) -> DataFrame:
            passing.append(scratch_path(self.spark, name))
            df.write.parquet(passing[-1])
            return self.spark.read.schema(df.schema).parquet(passing[-1])

        if last and not self.scratch:
            raise ValueError("an index that is kept takes further batches")
        hot = self._hot(docs, n)
        run = self._write(docs.mapInArrow(_blocks(self.width, not last), BLOCK), hot)
        own = self.spark.table(run)
        mine = own.select("hash", "digest", "low", "high", "windows")
        every, related = mine, None
        if self.runs:
            related = kept_for_now(reduce(DataFrame.unionByName, self._related(own, hot)), "related")
            every = related.withColumn("old", F.lit(1)).unionByName(mine.withColumn("old", F.lit(0)))
        flags = every.groupBy("hash").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.max(F.col("high") > F.col("low")).alias("shared"), *([F.max("old").alias("old")] if self.runs else []))
        many = F.col("a") != F.col("b")
        known = many | F.col("shared") | (F.col("old") > 0) if self.runs else many | F.col("shared")
        bits = bits_for(2 * size // 100) if size else BITS  # a block begins about every 22 words
        known_bits, many_bits = key_bitmaps(flags, "hash", [known, many], bits)

        found = kept_for_now(docs.mapInArrow(_places(self.width, known_bits, many_bits), "hash long, digest binary, doc long, windows binary, row long, start long, n long"), "found")
        lows = kept_for_now(every.select("digest", "low", "hash").mapInArrow(split_by(known_bits, True), "digest binary, low long, hash long").groupBy("hash", "digest").agg(F.min("low").alias("low")), "lows")
        judged = found.join(lows, ["hash", "digest"])  # both sides are shuffled for it, so Spark splits a passage that many documents have
        whole = judged.where("low < doc").select("doc", "row", "start", "n")
        held = every.select("windows", "hash", "low")
        if last:
            held = found.where("windows is not null").select("windows", "hash", F.col("doc").alias("low"))
            held = held if related is None else related.select("windows", "hash", "low").unionByName(held)
        unfolded = held.mapInArrow(_unfolded(many_bits), "hash long, low long, own long, place long")
        least = kept_for_now(unfolded.groupBy("hash", "own").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").drop("most"), "least")
        contested = judged.where("low >= doc and windows is not null").select("windows", "hash", "doc", "row", "start")
        singles = contested.mapInArrow(_unfolded(None), "hash long, doc long, row long, start long, own long, place long")
        parts = singles.join(least, ["hash", "own"]).where("least < doc")
        spans = saved(whole.unionByName(parts.select("doc", "row", (F.col("start") + F.col("place")).alias("start"), F.lit(1).cast("long").alias("n"))), "spans")
        for path in passing:
            remove(self.spark, path)
        release(self.spark)
        self._note([*self.runs, (run, 0, hot)])
        return spans

    def compact(self) -> None:
        """Merge the runs of each level that has more than `fan`, the lowest first."""
        level = 0
        while level <= max((x for _, x, _ in self.runs), default=-1):
            old = [(run, hot) for run, x, hot in self.runs if x == level]
            if len(old) > self.fan:
                # the files, not the tables: Spark 4.1 takes a union of bucketed tables for bucketed, and would group each run by itself
                both = reduce(DataFrame.unionByName, [self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{run}") for run, _ in old])
                hot = tuple(sorted({h for _, own in old for h in own})[: HOT * self.fan * 2])
                merged = self._write(both, hot)
                self._note([*[r for r in self.runs if r[1] != level], (merged, level + 1, hot)])
            level += 1

    def close(self) -> None:
        """Forget the tables; files stay for the next to open the index, unless it is scratch."""
        for run, *_ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        if self.scratch:
            remove(self.spark, self.path)


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 2
            texts, totals, gone = [], [], []
            for text, spans in zip(batch.column(k), batch.column(k + 1)):
                words = raw_text(text).split()
                if spans.is_valid:
                    flat = np.asarray(spans.values.flatten()[0]), np.asarray(spans.values.flatten()[1])
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, flat[0], 1)
                    np.add.at(mark, flat[0] + flat[1] + width - 1, -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    kept = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    kept = words
                texts.append(b" ".join(kept))
                totals.append(len(words))
                gone.append(len(words) - len(kept))
            made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], [f"c{i}" for i in range(k + 3)])

    return run


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, batches: int = 3, fan: int = 1, index: WindowIndex | None = None) -> DataFrame:
    """docs without words covered by a window that also starts in a document with a smaller id.

    Returns all columns of docs, text_col with the kept words joined by one space, and n_words and
    n_removed. Words split at ASCII white space. Windows are judged on the input, whole texts however
    long. Null text has no words and comes back empty; a text of fewer words than a window keeps them
    all. Rows of one id remove nothing from each other; a null id removes nothing and loses nothing. An
    empty table gives an empty table.

    With an index docs are one more batch of it, judged against all that it holds. Else they enter a
    scratch index in `batches` ranges of ids, cut at quantiles, smaller ids first, each after the second twice
    as large as all before it together, so that compaction merges the small ones; this gives the same as one batch.
    Blocks, window hashes and spans are shuffled; a passage that a third of all documents share is one
    row for each task after partial aggregates, and Spark splits the joins of such rows. Texts are shuffled only for documents that lose words (and the few that a
    filter of fixed size lets through).
    """
    spark = docs.sparkSession
    small_batches(spark)
    words, removed = distinct_names(docs.columns, "n_words", "n_removed")
    small = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    if index is None:
        own = WindowIndex(spark, width=width, fan=fan)
        parts = [1.0, 1.0]
        while len(parts) < batches:
            parts.append(2 * sum(parts))
        shares = [sum(parts[: i + 1]) / sum(parts[:batches]) for i in range(batches - 1)]
        told = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.percentile_approx("doc", shares or [0.5], 1000).alias("cuts")).first()
        cuts = sorted(set(told["cuts"] or [])) if shares else []  # ids of documents; the last batch may be empty
        found = []
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = small if low is None else small.where(F.col("doc") > low)
            part = part if high is None else part.where(F.col("doc") <= high)
            own.buckets = buckets_for(told["size"])
            if found:
                own.compact()
            share = parts[len(found)] / sum(parts[:batches])
            found.append(own.add(part, int(told["n"] * share), int(told["size"] * share), last=high is None))
        spans = reduce(DataFrame.unionByName, found)
        own.close()
    else:
        width, spans = index.width, index.add(small)
        index.compact()
    rows, mark, other, key = distinct_names([*docs.columns, words, removed], "_row", "_spans", "_doc", "_key")
    lost = spans.groupBy(F.col("doc").alias(other), F.col("row").alias(rows)).agg(F.collect_list(F.struct("start", "n")).alias(mark))
    affected = key_bitmap(spans.select(F.xxhash64("doc").alias("key")).distinct(), "key")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select("*", F.coalesce(F.xxhash64(F.col(id_col).cast("long")), F.lit(0).cast("long")).alias(key))
    passed = ", ".join([f"`{c}` {kinds[c]}" for c in docs.columns] + [f"`{key}` long"])
    none = F.lit(None).cast("array<struct<start:bigint,n:bigint>>").alias(mark)
    columns = [*[F.col(f"`{c}`") for c in rest], F.col(text_col)]
    clean = keyed.mapInArrow(split_by(affected, False), passed).select(*columns, none)
    hit = keyed.mapInArrow(split_by(affected, True), passed).join(lost, (F.col(id_col).cast("long") == F.col(other)) & (F.xxhash64(text_col) == F.col(rows)), "left").select(*columns, F.col(mark))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{text_col}` string", f"`{words}` long", f"`{removed}` long"])
    out = clean.mapInArrow(_cut(width), schema).unionByName(hit.mapInArrow(_cut(width), schema))
    return out.select(*[f"`{c}`" for c in docs.columns], f"`{words}`", f"`{removed}`")
