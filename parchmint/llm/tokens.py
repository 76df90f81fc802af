"""Token counts: pieces counted once for each distinct pre-token, joined to the frequencies of each document.

A byte-level BPE cuts a text into pre-tokens and never merges across them, so a document's count is the
sum over its distinct pre-tokens of frequency times pieces. No list of ids is made: a pass over the texts
gives all pre-tokens and how often they occur, each distinct one is cut into pieces once, and a second
pass joins those numbers to each document's frequencies. The most frequent pre-tokens, of a bounded
number and size, go to the workers; what a document has of others is joined by shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, join_one, saved

#: Distinct words that a worker holds before it hands their counts on, or starts anew.
HELD = 200_000
#: Code points that are split by a table of their own: Latin letters and common punctuation. Texts with others are split by the library.
PLAIN = (*range(0x250), *range(0x2010, 0x2028), 0x20AC, 0x2122)
#: Fixed value: the normalisation that the table stands for, as tokenizer files write it.
FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Fixed value: the split that the table stands for, as tokenizer files write it.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_OPEN: dict[str, Splitter] = {}


@cache
def _plain_pattern() -> re.Pattern:
    """SPLIT over plain code points and what their lower case adds."""
    kinds: dict[str, str] = {"L": "", "N": "", " ": ""}
    for c in sorted({x for i in PLAIN for x in (chr(i), *chr(i).lower())}):
        kind = " " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letter, digit, space = kinds["L"], kinds["N"], kinds[" "]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+")


@cache
def _bytes_as_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it prints, else one after U+00FF in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@cache
def _not_plain() -> re.Pattern:
    """A code point that is not plain, or one that only Python takes for white space."""
    return re.compile(f"[^{''.join(re.escape(chr(i)) for i in PLAIN if not 0x1C <= i <= 0x1F)}]")


class Splitter:
    """Pre-tokens of texts, and pieces of a pre-token, as one tokenizer file has them."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        cut = told["pre_tokenizer"] or {}
        steps = cut.get("pretokenizers", [cut])
        if told["model"]["type"] != "BPE" or told["model"].get("dropout") or steps[-1].get("type") != "ByteLevel" or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
            raise ValueError("token counts need a byte-level BPE whose added tokens are plain strings")
        self.library = Tokenizer.from_file(vocabulary)
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        added = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        normal = (told["normalizer"] or {}).get("normalizers")
        self.plain = normal == FOLDS and steps[:-1] == [split] and not steps[-1]["add_prefix_space"] and not steps[-1]["use_regex"]

    def units(self, text: str) -> tuple[list, int]:
        """Parts of a text that no pre-token spans, and how many added tokens stand between them.

        They are words, which `pretokens` splits, or, where the library split the text, tuples of one pre-token.
        """
        if self.added is None or not self.added.search(text):
            return self._between(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self._between(part)], len(parts) - 1

    def _between(self, text: str) -> list:
        if self.plain and not _not_plain().search(text):
            return unicodedata.normalize("NFC", text).lower().split()
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        byte = _bytes_as_letters()
        return [(bytes(map(byte.__getitem__, p)).decode(),) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pretokens(self, unit: str | tuple[str]) -> list[str] | tuple[str]:
        return unit if isinstance(unit, tuple) else _plain_pattern().findall(unit)

    def pieces(self, pretoken: str) -> int:
        """How many ids the vocabulary has for a pre-token; the text is not normalised again."""
        return sum(len(self.library.model.tokenize(p)) for p, _ in self.letters.pre_tokenize_str(pretoken))


def _splitter(vocabulary: str) -> Splitter:
    """One for each worker process and file."""
    if vocabulary not in _OPEN:
        _OPEN[vocabulary] = Splitter(vocabulary)
    return _OPEN[vocabulary]


def _tallies(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(piece, n) over the texts of a task, handed on whenever many words are held; a word is split once for all its occurrences."""
        own, held = _splitter(vocabulary), Counter()

        def out() -> pa.RecordBatch:
            found: Counter = Counter()
            for unit, n in held.items():
                for p in own.pretokens(unit):
                    found[p] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(own.units(text.as_py())[0])
                    if len(held) >= HELD:
                        yield out()
        yield out()

    return run


def _counted(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _splitter(vocabulary)
        for batch in batches:
            tokens = [own.pieces(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], ["piece", "n", "tokens"])

    return run


def _summed(vocabulary: str, often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, bytes, tokens, rest): tokens of frequent pre-tokens and added tokens, and frequencies of the others."""
        own, known = _splitter(vocabulary), often.value
        told: dict = {}  # of a word: tokens of its frequent pre-tokens, and its other pre-tokens

        def tell(unit: str | tuple[str]) -> tuple[int, list[str]]:
            found = own.pretokens(unit)
            if len(told) >= HELD:
                told.clear()
            told[unit] = out = sum(known.get(p, 0) for p in found), [p for p in found if p not in known]
            return out

        for batch in batches:
            sums, pieces, times, ends = [], [], [], [0]
            for text in batch.column(1):
                total, rest = 0, Counter()
                if text.is_valid:
                    found, total = own.units(text.as_py())
                    for unit, n in Counter(found).items():
                        tokens, others = told.get(unit) or tell(unit)
                        total += n * tokens
                        for p in others:
                            rest[p] += n
                sums.append(total)
                pieces += rest
                times += rest.values()
                ends.append(len(pieces))
            rests = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(times, pa.int64())], ["piece", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rests)], ["id", "bytes", "tokens", "rest"])

    return run


def frequent(vocab: DataFrame, most: int, most_bytes: int) -> int | None:
    """The least frequency such that pre-tokens of at least so many occurrences stay within both bounds; None if even the top does not."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    rows = sorted(vocab.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum(F.octet_length("piece")).alias("b"), F.min("n").alias("low")).collect(), key=lambda r: -r["step"])  # at most 252 rows
    cut, k, b = None, 0, 0
    for r in rows:
        k, b = k + r["k"], b + r["b"]
        if k > most or b > most_bytes:
            break
        cut = r["low"]
    return cut


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, most: int = 1 << 17, most_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the tokenizer file's, without tokens that it adds at the ends; the string of an added token
    inside a text is that token. Whole texts however long, null counts as empty. Null ids and repeated rows
    stay rows of their own. An empty table gives an empty table. Other columns of docs are not read.

    `most` and `most_bytes` bound the pre-tokens that travel to every worker; they are the most frequent of
    the whole table, and change the plan only. Occurrences of the others are shuffled as (row, pre-token,
    times), pre-tokens in more than a thousandth of those rows by broadcast.
    """
    spark = docs.sparkSession
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tallies = small.select("text").mapInArrow(_tallies(vocabulary), "piece string, n long")
    vocab = saved(tallies.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(_counted(vocabulary), "piece string, n long, tokens long"), "pretokens")
    cut = frequent(vocab, most, most_bytes)
    often = F.lit(False) if cut is None else F.col("n") >= cut
    known = spark.sparkContext.broadcast({r["piece"]: r["tokens"] for r in vocab.where(often).select("piece", "tokens").collect()})  # at most `most` rows
    passed = small.select("id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")).mapInArrow(_summed(vocabulary, known), "id long, bytes long, tokens long, rest array<struct<piece:string,times:long>>")
    rows = saved(passed.withColumn("row", F.monotonically_increasing_id()), "counted")  # fixed once it is written
    rest = rows.select("row", F.explode("rest").alias("x")).select("row", "x.piece", "x.times")
    occurs = rest.groupBy("piece").agg(F.count("*").alias("count"))
    one = saved(vocab.where(~often).select("piece", F.col("tokens").alias("each")).join(occurs, "piece"), "rare")
    total = one.agg(F.sum("count").alias("n")).first()["n"] or 0
    more = join_one(rest, one, ["piece"], "count", total).groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    n = F.col("tokens") + F.coalesce("more", F.lit(0))
    n_bytes, n_tokens, over = distinct_names([id_col], "n_bytes", "n_tokens", "over_limit")
    return rows.drop("rest").join(more, "row", "left").select(F.col("id").alias(id_col), F.col("bytes").alias(n_bytes), n.alias(n_tokens), (n > limit).alias(over))
