"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Each leaf draws -ln(u) / weight, u a hash of the key and the leaf's place: an exponential clock. The
draw of a rack or region is the least of its leaves' draws, hence exponential with the sum of their
weights, and the descent follows the least draw from level to level. A leaf whose weight changes moves
its own draw only: keys come from anywhere into a leaf that gains weight, or leave the one that loses
it, and never move between others, whatever the number of shards.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, running_total


@dataclass(frozen=True)
class Leaf:
    """A shard: its number, where it stands and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Shards of weight 1, per_rack in a rack, racks in a region; the next shard after full regions opens one."""
    return [Leaf(i, i // (racks * per_rack), i // per_rack % racks) for i in range(shards)]


_TREE = "array<struct<n:int,racks:array<struct<n:int,leaves:array<struct<n:int,weight:double>>>>>>"


def _tree(leaves: Sequence[Leaf]) -> Column:
    """The tree as one literal of nested arrays in order of numbers; leaves of weight 0 are left out."""
    alive = sorted((x for x in leaves if x.weight > 0), key=lambda x: (x.region, x.rack, x.shard))
    if not alive:
        raise ValueError("no shard has weight")
    regions = [{"n": region, "racks": [{"n": rack, "leaves": [{"n": x.shard, "weight": x.weight} for x in own]} for rack, own in groupby(racks, key=lambda x: x.rack)]} for region, racks in groupby(alive, key=lambda x: x.region)]
    return F.from_json(F.lit(json.dumps(regions)), _TREE)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _least(nodes: Column, draw: Callable[[Column], Column]) -> Column:
    """The node of the least draw, the first of equals."""
    at = F.array_min(F.transform(nodes, lambda x, i: F.struct(draw(x).alias("draw"), i.alias("i"))))["i"]
    return F.get(nodes, at)


def place(key: Column, leaves: Sequence[Leaf], salt: int = 0) -> Column:
    """The shard of a key: the tree and the key decide alone. Weights of 0 draw nothing; a tie goes to the lower number.

    The descent takes the region of the least draw, of its racks the one of the least draw, and of that one's
    shards the one of the least. The tree is data, so the expression is as large for a thousand shards as for two.
    """

    def clock(region: Column, rack: Column, leaf: Column) -> Column:
        """u is odd/2^53: never 0 or 1, and exact as a double."""
        h = F.xxhash64(key, F.lit(salt), region, rack, leaf["n"])
        u = (F.shiftrightunsigned(h, 12) * 2 + 1).cast("double") / F.lit(float(2**53))
        return -F.log(u) / leaf["weight"]

    def of_rack(region: Column, rack: Column) -> Column:
        return F.array_min(F.transform(rack["leaves"], lambda x: clock(region, rack["n"], x)))

    def of_region(region: Column) -> Column:
        return F.array_min(F.transform(region["racks"], lambda k: of_rack(region["n"], k)))

    def in_region(region: Column) -> Column:
        return _bound(_least(region["racks"], lambda k: of_rack(region["n"], k)), lambda rack: _least(rack["leaves"], lambda x: clock(region["n"], rack["n"], x))["n"])

    return _bound(_least(_tree(leaves), of_region), in_region)


def shard(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096) -> DataFrame:
    """Place documents by id: columns of docs without the text, and _size, _crc, _shard, _grown, _slot.

    The law is `key`: the id and the tree decide, so a null id is a key like any other and repeated
    ids share a shard. _size is UTF-8 bytes of the whole text and 1 (null: 1), _crc the unsigned CRC-32.
    _grown is the shard in the tree `grown` (null without one). When that tree has one more shard, keys
    move into it only. Columns of these names get underscores before ours. _slot numbers a shard's rows from 0 without gaps, by hash bucket and id;
    equal rows get adjacent slots in any order. An empty table gives an empty table.

    Nothing but ids, sizes and checksums is shuffled; each shard is numbered by many tasks.
    """
    size, crc, at, more, slot = distinct_names(docs.columns, "_size", "_crc", "_shard", "_grown", "_slot")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    made = docs.select(*rest, (F.octet_length(data) + 1).cast("long").alias(size), F.crc32(data).alias(crc), place(F.col(id_col), leaves).alias(at), (place(F.col(id_col), grown) if grown else F.lit(None).cast("int")).alias(more))
    return running_total(made, [at], [F.col(id_col), F.col(crc), F.col(size)], F.col(id_col), F.lit(1), slot, buckets)
