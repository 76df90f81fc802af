"""Fill-in-the-middle by a parallel automaton scan.

Units of a text (white space and the word after it; white space at the end) are counted by an automaton of
three states: start of the text, after white space, inside a word. A chunk of a text does not know its entry
state, so it gives a function: for each state the one it ends in and how many units begin on the way. These
functions compose associatively, whence every chunk's entry state and the units before it; a cut then lies in
the one chunk whose range of units holds it, and only that chunk is scanned for the place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import distinct_names, raw_text, saved

START, SPACE, WORD = 0, 1, 2
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The marks before the three parts.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a text that are scanned as one chunk; longer texts are dealt out chunk by chunk.
CHUNK = 1 << 16


def unit_starts(data: np.ndarray, entry: int) -> np.ndarray:
    """Offsets of bytes at which a unit begins, for a chunk entered in a state."""
    space = _IS_SPACE[data]
    begins = np.empty(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    if len(data):
        begins[0] = entry == START or entry == WORD and space[0]
    return np.flatnonzero(begins)


def transition(data: np.ndarray) -> tuple[list[int], list[int]]:
    """For each entry state of a chunk: the state at its end, and the units that begin in it."""
    if not len(data):
        return [START, SPACE, WORD], [0, 0, 0]
    inside = len(unit_starts(data, SPACE))
    end = SPACE if _IS_SPACE[data[-1]] else WORD
    return [end] * 3, [inside + 1, inside, inside + bool(_IS_SPACE[data[0]])]


def composed(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions of every prefix of chunks, from the functions of the chunks (rows of three), by doubling."""
    ends, counts, step = ends.copy(), counts.copy(), 1
    while step < len(ends):
        first, first_n = ends[:-step], counts[:-step]
        then, then_n = ends[step:], counts[step:]
        ends[step:], counts[step:] = np.take_along_axis(then, first, 1), first_n + np.take_along_axis(then_n, first, 1)
        step *= 2
    return ends, counts


def characters(data: np.ndarray) -> int:
    """Code points that begin in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _place(data: np.ndarray, entry: int, k: int) -> int:
    """Code points before unit k of a chunk; all of them if it has just k."""
    at = unit_starts(data, entry)
    return characters(data[: at[k]] if k < len(at) else data)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: the last four columns are the text and three draws; those become n and two places."""
    for batch in batches:
        made: list[list[int]] = [[], [], []]
        draws = [c.to_pylist() for c in batch.columns[-2:]]
        for text, *drawn in zip(batch.column(batch.num_columns - 3), *draws):
            data = np.frombuffer(raw_text(text), np.uint8)
            at = unit_starts(data, START)
            n = len(at)
            cuts = sorted(d % (n + 1) for d in drawn)
            places = [characters(data[: at[k]]) if k < n else characters(data) for k in cuts]
            for values, x in zip(made, (n, *places)):
                values.append(x)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *[pa.array(x, pa.int64()) for x in made]], [*batch.schema.names[:-3], "n", "first", "second"])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, place, bytes) of each chunk of (row, text), a few at a time."""
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer()
                for at in range(0, raw.size, 64 * size):
                    starts = range(at, min(raw.size, at + 64 * size), size)
                    parts = [raw.slice(a, min(size, raw.size - a)).to_pybytes() for a in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(parts), row.type), pa.array([a // size for a in starts], pa.int64()), pa.array(parts, pa.binary())], ["row", "chunk", "data"])

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.frombuffer(d.as_buffer(), np.uint8) for d in batch.column(2)]
        told = [transition(d) for d in data]
        made = [pa.array([t[i] for t in told], pa.list_(pa.int64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made, pa.array([characters(d) for d in data], pa.int64())], ["row", "chunk", "ends", "counts", "chars"])


def _selected(table: pa.Table) -> pa.Table:
    """The chunks of one row that hold its cuts: entry state, unit within the chunk, code points before; a row for each cut."""
    table = table.sort_by("chunk")
    ends, counts = (np.array(table.column(c).to_pylist(), np.int64).reshape(-1, 3) for c in ("ends", "counts"))
    chars = np.concatenate([[0], np.cumsum(np.asarray(table.column("chars")))])
    state, before = composed(ends, counts)
    entry, before = np.concatenate([[START], state[:, START]]), np.concatenate([[0], before[:, START]])
    n = int(before[-1])
    drawn = [table.column(c)[0].as_py() for c in ("h1", "h2")]
    out: dict[str, list] = {c: [] for c in ("row", "cut", "n", "chunk", "entry", "unit", "base")}
    for cut, k in enumerate(sorted(d % (n + 1) for d in drawn)):
        j = min(int(np.searchsorted(before, k, "right")) - 1, len(ends) - 1)  # the last chunk has the end
        for c, x in zip(out, (table.column("row")[0].as_py(), cut, n, j, int(entry[j]), k - int(before[j]), int(chars[j]))):
            out[c].append(x)
    return pa.table(out, schema=pa.schema([("row", table.schema.field("row").type), *[(c, pa.int64()) for c in list(out)[1:]]]))


def _places(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scans two chunks of a text: the last two columns are the text and its cuts, which become n and two places."""
        for batch in batches:
            made: list[list[int]] = [[], [], []]
            for text, cuts in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()):
                raw = text.as_buffer()
                cuts.sort(key=lambda c: c["cut"])
                places = [c["base"] + _place(np.frombuffer(raw.slice(c["chunk"] * size, min(size, raw.size - c["chunk"] * size)), np.uint8), c["entry"], c["unit"]) for c in cuts]
                for values, x in zip(made, (cuts[0]["n"], *places)):
                    values.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(x, pa.int64()) for x in made]], [*batch.schema.names[:-2], "n", "first", "second"])

    return run


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of `seed:id`; a null id draws as the empty string would."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. Parts hold no mark, so each mark is found once."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = CHUNK) -> DataFrame:
    """All columns of docs, and n, form, prefix_chars, middle_chars and output.

    n is the number of units of the whole text. Two cuts between units, drawn by seed and id, part it into
    prefix, middle and suffix; rate percent of the texts change their form, of those spm_rate percent to
    suffix, prefix, middle (spm), the others to prefix, suffix, middle (psm). Empty texts and texts with a mark
    stay plain, with null prefix_chars and middle_chars; null counts as empty. A null id draws as an empty id.
    Repeated rows come out alike, ties do not arise; new columns get underscores before their names where
    docs has such columns. An empty table gives an empty table.

    A text of one chunk is cut where it lies. Chunks of longer ones are dealt over all tasks for their
    functions; then only functions (a row of numbers for each chunk) meet, one text's in one task, and the
    longer texts are shuffled once more, to their cuts.
    """
    n, form, prefix, middle, output = distinct_names(docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")
    h = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    k = len(docs.columns)
    kinds = [*[f.dataType for f in docs.schema.fields], LongType(), LongType(), LongType()]
    placed = StructType([StructField(f"c{i}", kind) for i, kind in enumerate(kinds)])
    short = docs.where(F.octet_length(text) <= chunk).select(*own, text.alias("text"), h[0].alias("h1"), h[1].alias("h2")).mapInArrow(_short, placed)

    row = F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text), 256)
    long = docs.where(F.octet_length(text) > chunk).select(*own, text.alias("text"), row.alias("row"), h[0].alias("h1"), h[1].alias("h2"))
    dealt = long.select("row", "text").mapInArrow(_chunks(chunk), "row string, chunk long, data binary").repartition("row", "chunk")
    functions = saved(dealt.mapInArrow(_functions, "row string, chunk long, ends array<long>, counts array<long>, chars long").dropDuplicates(["row", "chunk"]), "functions")
    found = functions.join(long.select("row", "h1", "h2").dropDuplicates(["row"]), "row").groupBy("row").applyInArrow(_selected, "row string, cut long, n long, chunk long, entry long, unit long, base long")
    cuts = found.groupBy("row").agg(F.collect_list(F.struct("cut", "n", "chunk", "entry", "unit", "base")).alias("cuts"))  # two a row
    met = long.join(cuts, "row").select(*[f"c{i}" for i in range(k)], "text", "cuts").mapInArrow(_places(chunk), placed)

    both = short.unionByName(met)
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    h = draws(F.col(f"c{docs.columns.index(id_col)}"), seed)
    count, first, second = F.col(f"c{k}"), F.col(f"c{k + 1}").cast("int"), F.col(f"c{k + 2}").cast("int")
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    kind = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    head, mid, tail = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.char_length(text))
    p, s, m = map(F.lit, MARKS)
    made = F.when(F.col("kind") == "plain", text).when(F.col("kind") == "psm", F.concat(p, head, s, tail, m, mid)).otherwise(F.concat(s, tail, p, head, m, mid))
    cut = F.col("kind") != "plain"
    return both.withColumn("kind", kind).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        count.alias(n),
        F.col("kind").alias(form),
        F.when(cut, first.cast("long")).alias(prefix),
        F.when(cut, (second - first).cast("long")).alias(middle),
        made.alias(output),
    )
