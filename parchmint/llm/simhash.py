"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distances checked.

64 bits are cut into 6 blocks. Two fingerprints that differ in at most 3 bits differ in at most 3
blocks, so they agree on the other 3: each of the 20 choices of 3 blocks gives one key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, raw_text, saved, small_batches
from .graph import components

#: Members of a bucket that one task compares with each other; larger buckets are cut into pairs of chunks.
CHUNK = 1024


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(stops)
    hashes = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        count += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(raw_text(t), shingle, seed) for t in batch.columns[-1]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def block_masks(blocks: int = 6, agree: int = 3) -> list[int]:
    """Signed 64-bit masks, one for each choice of `agree` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = []
    for own in combinations(parts, agree):
        mask = sum(own)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def spanning(values: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over uint64 values, or rows of them, within the distance, not all their pairs."""
    left, a, b = np.arange(len(values)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            apart = np.bitwise_count(values[left] ^ values[here])
            near = (apart if apart.ndim == 1 else apart.sum(1)) <= distance
            found = left[near]
            if len(found):
                left = left[~near]
                queue += found.tolist()
                a += [int(here)] * len(found)
                b += found.tolist()
    return a, b


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""

        def out(fps: np.ndarray, ends: list[int]) -> pa.RecordBatch:
            made_a, made_b, at = [], [], 0
            for end in ends:
                own = fps[at:end]
                if len(own) > 1:
                    a, b = spanning(own, distance)
                    made_a.append(own[a])
                    made_b.append(own[b])
                at = end
            ab = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (made_a, made_b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ab], ["a", "b"])

        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.asarray(batch.column(i)) for i in range(5)]
            if kept is not None:
                own = [np.concatenate(x) for x in zip(kept, own)]
            new = np.zeros(len(own[0]) - 1, bool)
            for x in own[:4]:
                new |= x[1:] != x[:-1]
            ends = (np.flatnonzero(new) + 1).tolist()
            last = ends[-1] if ends else 0
            yield out(own[4].view(np.uint64), ends)
            kept = [x[last:] for x in own]
        if kept is not None:
            yield out(kept[4].view(np.uint64), [len(kept[4])])

    return run


def fingerprint_links(fps: DataFrame, distance: int = 3, blocks: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints, enough to connect all that are within distance.

    fps has one long column fp without repeats. Buckets are counted first; one with more than `chunk`
    members is cut into chunks by hash and each pair of chunks becomes a bucket of its own, so no task
    gets a bucket whole, however many near copies share it. Inside a bucket a spanning forest replaces
    the pairs.
    """
    masks = block_masks(blocks, blocks - distance)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    many = rows.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    return _dealt(rows.join(many, ["c", "key"]), chunk).mapInArrow(_links(distance), "a long, b long")


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows (c, key, fp, n) by bucket (c, key, lo, hi): a bucket of n > chunk members is cut and its chunks meet in pairs."""
    rows = rows.withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, own).alias("lo"), F.greatest(j, own).alias("hi")))
    dealt = rows.select("c", "key", "fp", F.explode(pairs).alias("p")).select("c", "key", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), "fp")
    return dealt.repartition("c", "key", "lo", "hi").sortWithinPartitions("c", "key", "lo", "hi", "fp")


def _rooted(small: DataFrame, low: Column, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, low, root) for each fingerprint: the aggregate low of its rows, and the fingerprint that names its group."""
    classes = saved(small.groupBy("fp").agg(low.alias("low")), "classes")
    roots = components(links(classes.select("fp")))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits) and component_id.

    Words are split at ASCII white space with A-Z lowered; a text of fewer words than a shingle is one
    shingle, null or no words gives fingerprint zero, which links like any other. Documents with the
    same fingerprint are one class; classes within the distance are linked, and component_id is the
    smallest id reachable, itself included. Null ids are never smallest unless all are null. Repeated
    rows stay rows. An empty table gives an empty table.

    The text is read once; after that only 16-byte rows move.
    """
    small_batches(docs.sparkSession)
    fp, comp = distinct_names([id_col], "fingerprint", "component_id")
    small = saved(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle, seed), "id long, fp long"), "simhash")
    rooted = _rooted(small, F.min("id"), lambda fps: fingerprint_links(fps, distance))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    known = rooted.join(lowest, "root").select("fp", "component")
    return small.join(known, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias(fp), F.col("component").alias(comp))


def _representatives(docs: DataFrame, id_col: str, text_col: str, seed: int, made: Callable, kind: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    small_batches(docs.sparkSession)
    one, two = distinct_names(docs.columns, "_key1", "_key2")
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    keyed = docs.select("*", F.xxhash64(*parts).alias(one), F.xxhash64(F.lit(seed), *parts).alias(two))
    keys = keyed.select(F.col(id_col).cast("long").alias("id"), F.col(one).alias("key1"), F.col(two).alias("key2"), F.col(text_col).alias("text"))
    small = saved(keys.mapInArrow(made, f"id long, key1 long, key2 long, fp {kind}"), "simhash")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key1", "key2"))
    stay = _rooted(small, least, links).groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key1").alias(one), F.col("low.key2").alias(two))
    return keyed.join(stay, [one, two]).dropDuplicates([one, two]).select(*[f"`{c}`" for c in docs.columns])


def simhash_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs for each SimHash group, whole: the one with the smallest id, null ids last.

    A row goes by a 128-bit hash of all its columns, so rows that share an id, or have none, stay apart;
    the smallest hash decides between them. Rows equal in all columns count as one. Groups are those of
    simhash_components. Texts are shuffled once.
    """
    return _representatives(docs, id_col, text_col, seed, _fingerprints(shingle, seed), "long", lambda fps: fingerprint_links(fps, distance))


#: Words of 64 bits in a wide fingerprint.
WIDE = 4


def wide_fingerprint(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """WIDE SimHashes of a text's set of word shingles, by as many hashes of each; zeros without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(WIDE, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = ([0, *ends[: len(words) - shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()) if len(words) > shingle else ([0], [len(flat)])
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops)))
    count = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        own = hashes[i : i + (1 << 13)]
        other = np.empty((len(own), WIDE), np.uint64)
        for k in range(WIDE):  # each an odd multiple, its high bits brought down
            x = own * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            other[:, k] = x ^ (x >> np.uint64(32))
        count += np.unpackbits(other.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)


def _wide_fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_fingerprint(raw_text(t), shingle, seed).tobytes() for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], [*batch.schema.names[:-1], "fp"])

    return run


def distance_for(similarity: float, bits: int = 64 * WIDE, spare: float = 1.25) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity differ, with `spare` standard deviations added.

    Sets of similarity s stand at an angle whose cosine is 2 s / (1 + s); each bit differs with the share of
    the half turn that the angle is.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + spare * math.sqrt(bits * p * (1 - p)))


def _block_keys(tables: int, width: int, seed: int):
    """(bucket, fp): for each fingerprint and table the table's number and the `width` bits that it reads."""
    draw = np.random.default_rng(seed)
    places = np.stack([draw.choice(64 * WIDE, width, replace=False) for _ in range(tables)])
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                column = whole.column(0).slice(at, 1000)
                n = len(column)
                bits = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, 8 * WIDE), axis=1, bitorder="little")
                keys = np.stack([(bits[:, own] @ powers) + (c << width) for c, own in enumerate(places)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), column.take(pa.array(np.repeat(np.arange(n), tables)))], ["bucket", "fp"])

    return run


def _wide_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, part, fp) come sorted by bucket and part; one may go on in the next batch."""

        def out(fps: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            two = starts[ends - starts == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1) <= distance
            made_a, made_b = [two[near]], [two[near] + 1]
            for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                x, y = spanning(fps[a:b], distance)
                made_a.append(np.array(x, np.int64) + a)
                made_b.append(np.array(y, np.int64) + a)
            ab = [pa.array([fps[i].tobytes() for i in np.concatenate(x).tolist()], pa.binary()) for x in (made_a, made_b)]
            return pa.RecordBatch.from_arrays(ab, ["a", "b"])

        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE)]
            if kept is not None:
                own = [np.concatenate(x) for x in zip(kept, own)]
            ends = np.flatnonzero((own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])) + 1
            last = int(ends[-1]) if len(ends) else 0
            if last:
                yield out(own[2], ends)
            kept = [x[last:] for x in own]
        if kept is not None:
            yield out(kept[2], np.array([len(kept[2])]))

    return run


def wide_links(fps: DataFrame, distance: int, tables: int = 64, width: int = 20, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct wide fingerprints within distance that agree on the bits of one of the tables.

    fps has one binary column fp without repeats. Every fingerprint goes into a bucket of each table, alone or
    not, so rows go with the fingerprints alone. Buckets of more than `chunk` members are counted first (a row
    for each task and bucket) and cut into chunks by hash that meet in pairs, as parts of the bucket; as each
    holds more than `chunk` fingerprints, there are at most tables / chunk as many of them, and they are joined.
    """
    rows = fps.mapInArrow(_block_keys(tables, width, seed), "bucket long, fp binary")
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(F.col("bucket").alias("hot"), F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    marked = rows.join(hot, F.col("bucket") == F.col("hot"), "left").select("bucket", "fp", "k")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(j, own) * F.col("k") + F.greatest(j, own))
    dealt = marked.select("bucket", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(parts)).alias("part"), "fp")
    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "fp").mapInArrow(_wide_links(distance), "a binary, b binary")


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42, tables: int = 64, width: int = 20) -> DataFrame:
    """One row of docs for each group of near copies, whole, chosen as by simhash_representatives.

    Near copies share `similarity` of their sets of word shingles, as told by 256 bits of SimHash: pairs that agree
    on all bits of one of the tables are candidates, and their Hamming distance decides. Estimates have a
    spread: of pairs hardly above the similarity nine in ten are found, above 0.85 nearly all, and many
    between 0.7 and 0.8 too. Null texts and texts without words are one group. An empty table gives an empty table.
    """
    distance = distance_for(similarity)
    return _representatives(docs, id_col, text_col, seed, _wide_fingerprints(shingle, seed), "binary", lambda fps: wide_links(fps, distance, tables, width, seed))
