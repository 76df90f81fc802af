"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are tokenised and cut: whole sequences first, the rest of each is one length of a
histogram. Packing works on the histogram alone, longest lengths first, and gives patterns with
counts; pieces then take places of their length by rank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, saved, small_batches

#: Entries of each worker's table of tokenised words; an older generation of as many stays beside it.
CACHE = 120_000
_PLAIN = re.compile(r"[\x21-\x7eÀ-ɏ]+")
_ODD_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]")
_ANY_SPACE = re.compile(r"\s")
_WITH_SPACE = re.compile(r"\s*\S+|\s+")
_END = b"\0\0\0\0"
_CODERS: dict[tuple[str, str | None], Coder] = {}


class Coder(dict):
    """Little-endian 32-bit ids of a word with the space before it, by word.

    A pre-token never spans the change from other characters to white space, so a text is the
    concatenation of its words with the white space before each. New words go through the rank file
    (the same vocabulary as ranks) if it is given and the word is plain Latin script, else through the
    tokenizer file. An end of ASCII marks other than the apostrophe is a pre-token of its own, as is
    a line break between two words. A text with the string of an added token goes through the
    tokenizer file whole, which gives that string its own id.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None, added: tuple[str, ...] = ()) -> None:
        self.vocabulary, self.old, self.bare, self.whole = vocabulary, {}, {}, None
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and (text.isascii() and text.isprintable() and " " not in text[1:] or _PLAIN.fullmatch(text.removeprefix(" "))):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return self.by_file(text)

    def by_file(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def alone(self, word: str) -> bytes:
        """Ids of a word without a space before it."""
        if (ids := self.bare.get(word)) is None:
            base = word.rstrip(".,;:!?*&%$#")
            ids = self.alone(base) + self.alone(word[len(base) :]) if base and len(base) < len(word) and base.isalpha() else self.encode(word)
            if len(self.bare) < CACHE // 4 and len(word) <= 64:
                self.bare[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            head, line, rest = word.partition("\n")
            if line:
                if not head or not rest or _ANY_SPACE.search(rest) or _ANY_SPACE.search(head):
                    return self.encode(" " + word)
                return self[head] + self.alone("\n") + self.alone(rest)
            base = word.rstrip(".,;:!?*&%$#")
            if base and len(base) < len(word) and base.isalpha():
                ids = self[base] + self.alone(word[len(base) :])
            else:
                ids = self.encode(" " + word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.by_file(text)
        if not text.isascii() and _ODD_SPACE.search(text):
            return self.encode(text)
        if "  " in text or "\n " in text or "\t " in text or "\r " in text or "\x0b " in text or "\x0c " in text or text[:1] == " " or text[-1:] == " ":
            return b"".join([self[x[1:]] if x[0] == " " and len(x) > 1 and not x[1].isspace() else self.encode(x) for x in _WITH_SPACE.findall(text)])
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def added_tokens(vocabulary: str) -> tuple[str, ...]:
    """Strings of the tokenizer file's added tokens."""
    from tokenizers import Tokenizer

    return tuple(sorted(t.content for t in Tokenizer.from_file(vocabulary).get_added_tokens_decoder().values()))


def coder(vocabulary: str, ranks: str | None = None, pattern: str | None = None, added: tuple[str, ...] = ()) -> Coder:
    """One coder for each worker process and vocabulary."""
    if (vocabulary, ranks) not in _CODERS:
        _CODERS[vocabulary, ranks] = Coder(vocabulary, ranks, pattern, added)
    return _CODERS[vocabulary, ranks]


def _pieces(width: int, vocabulary: str, ranks: str | None, pattern: str | None, added: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, ranks, pattern, added)
        for batch in batches:
            docs, starts, lengths, sums, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.ids(text.as_py() or "") + _END
                n = len(ids) // 4
                for at in range(0, n, width):
                    docs.append(doc)
                    starts.append(at)
                    lengths.append(min(width, n - at))
                    sums.append(zlib.crc32(ids[4 * at : 4 * (at + width)]))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, lengths, sums, totals)], ["doc", "start", "length", "crc", "total"])

    return run


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold every length of the histogram, none longer than width.

    Lengths are placed longest first, each into the shortest packs so far. Where even those have too
    little room, a new pack opens and is the shortest until it is full, so what is left of a length
    opens as many full packs of it as it takes and one for the rest. Packs of one fill and pattern
    count together, so the work depends on width and not on how many pieces there are.
    """
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, list[int]]] = []
    for length in sorted(histogram, reverse=True):
        left, changed = histogram[length], []
        while left:
            fill = min(packs, default=width)
            if fill + length > width:
                each = width // length
                changed += [(n, (length,) * k) for n, k in ((left // each, each), (1, left % each)) if n and k]
                break
            count, pattern = packs[fill].pop()
            used = min(count, left)
            if used < count:
                packs[fill].append((count - used, pattern))
            if not packs[fill]:
                del packs[fill]
            changed.append((used, (*pattern, length)))
            left -= used
            if changed[-1][0] and fill + length + 1 <= width:
                packs.setdefault(fill + length, []).append(changed.pop())
        for count, pattern in changed:
            if sum(pattern) < width:
                packs.setdefault(sum(pattern), []).append((count, pattern))
            else:
                done.append((count, list(pattern)))
    return done + [(count, list(pattern)) for own in packs.values() for count, pattern in own]


def places(patterns: list[tuple[int, list[int]]]) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its runs of ranks (from, to, first sequence, offset), and how many sequences there are."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            own = out.setdefault(length, [])
            rank = own[-1][1] if own else 0
            own.append((rank, rank + count, first, offset))
            offset += length
        first += count
    return out, first


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, width: int = 1024, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 0; null or empty text is id 0 alone, so each document has a
    piece. It is cut after every `width` ids, however long it is; full pieces are sequences, the rest is
    packed. Ids are those of the tokenizer file as it is loaded: an added token's string in a text is
    that token. Sequence ids have no gaps. Repeated rows are documents of their own, a null id stays
    null, pieces that tie in all columns take their places in any order, an empty table gives an empty
    table. Other columns are not read.

    The histogram (at most `width` rows) and the places (as many as the patterns have lengths, which
    depends on width alone) are all that meets on the driver. Ranks of one length are counted over
    hash buckets, so a length that a third of all documents share is ranked by many tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    made = saved(text.mapInArrow(_pieces(width, vocabulary, ranks, pattern, added_tokens(vocabulary)), "doc long, start long, length long, crc long, total long"), "pieces")
    histogram = {r["length"]: r["n"] for r in made.where(F.col("length") < width).groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, sequences = places(shortest_pack_first(histogram, width))
    table = [(n, [tuple(x) for x in own]) for n, own in runs.items()] + [(width, [(0, 1 << 62, sequences, 0)])]
    lookup = spark.createDataFrame(table, "n long, runs array<struct<a:long,b:long,first:long,offset:long>>")
    ranked = running_total(made, ["length"], [F.col("doc"), F.col("start"), F.col("crc")], F.struct("doc", "start"), F.lit(1), "rank", buckets)
    held = ranked.join(F.broadcast(lookup), F.col("length") == F.col("n"))  # at most width rows
    run = F.filter("runs", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["b"]))[0]
    told = held.withColumn("run", run)
    return told.select(F.col("doc").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), (F.col("run.first") + F.col("rank") - F.col("run.a")).alias("sequence_id"), F.col("run.offset").alias("offset"))
