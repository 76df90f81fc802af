"""Line deduplication: lines found in many documents leave every document.

Lines are exploded and normalised, a 128-bit hash of each is counted once a document, hashes that reach
the threshold are joined back, and the lines that stay are put together by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import key_bitmap, split_by
from .common import SPACES, distinct_names, join_one, raw_text, saved, small_batches


def _key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line) if (line := line.strip(SPACES).lower()) else b""


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column(0), batch.column(1)):
            own = {_key(line) for line in raw_text(text).split(b"\n")} - {b""}
            doc = doc.as_py()
            ids += [doc] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])


def _rebuild(batches: Iterator[pa.RecordBatch], often: frozenset[bytes] = frozenset()) -> Iterator[pa.RecordBatch]:
    """Texts without lines whose key is in often or in the row's own list, the last column."""
    for batch in batches:
        rest, texts, counts, drops = [batch.column(i) for i in range(batch.num_columns - 2)], [], [], []
        for text, drop in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            lines = raw_text(text).split(b"\n")
            gone = frozenset(drop.as_py()) if drop.is_valid else often
            kept = [line for line in lines if _key(line) not in gone] if gone else lines
            counts.append(len(lines))
            drops.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept))
        made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())]
        yield pa.RecordBatch.from_arrays(rest + made, [f"c{i}" for i in range(len(rest) + 3)])


def _without(often: Broadcast):
    return lambda batches: _rebuild(batches, often.value)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, few: int = 100_000) -> DataFrame:
    """docs without the lines whose key is found in at least min_docs documents.

    Returns all columns of docs, text_col with the lines that stay, and n_lines and n_dropped (named
    with underscores before them if docs has such columns). A document is a row; repeated rows count
    each. A key is the line without white space at both ends and with A-Z lowered; an empty key is
    never dropped. Null text counts as one empty line and comes back empty; a text is read whole,
    however long. A null id is an id. An empty table gives an empty table. The order of lines stays.

    Only 16-byte hashes are shuffled for the counts, one row for each task and key after partial
    counts. Up to `few` frequent keys (1.6 MB) are broadcast and texts do not move; more of them are
    joined, those with many documents by broadcast, and only texts that lose lines are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lines, dropped, gone, other, hash_ = distinct_names(docs.columns, "n_lines", "n_dropped", "_gone", "_other", "_hash")
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_keys, "id long, key binary")
    often = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "often")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{text_col}` string", f"`{lines}` long", f"`{dropped}` long"])
    columns, none = [*[F.col(f"`{c}`") for c in rest], F.col(text_col)], F.lit(None).cast("array<binary>").alias(gone)
    if often.count() <= few:
        known = spark.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in often.select("key").collect()))
        out = docs.select(*columns, none).mapInArrow(_without(known), schema)
    else:
        rows = saved(keys, "keys")
        hit = saved(join_one(rows, often, ["key"], "n", rows.count()).select("id", "key"), "hits")
        lists = hit.groupBy("id").agg(F.collect_set("key").alias(gone)).withColumnRenamed("id", other)
        affected = key_bitmap(hit.select(F.coalesce(F.xxhash64("id"), F.lit(0).cast("long")).alias("key")).distinct(), "key")
        keyed = docs.select("*", F.coalesce(F.xxhash64(F.col(id_col).cast("long")), F.lit(0).cast("long")).alias(hash_))
        passed = ", ".join([f"`{c}` {kinds[c]}" for c in docs.columns] + [f"`{hash_}` long"])
        clean = keyed.mapInArrow(split_by(affected, False), passed).select(*columns, none)
        touched = keyed.mapInArrow(split_by(affected, True), passed).join(lists, F.col(id_col).cast("long").eqNullSafe(F.col(other)), "left").select(*columns, gone)
        out = clean.mapInArrow(_rebuild, schema).unionByName(touched.mapInArrow(_rebuild, schema))
    return out.select(*[f"`{c}`" for c in docs.columns], f"`{lines}`", f"`{dropped}`")
