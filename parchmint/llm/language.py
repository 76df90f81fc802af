"""Language by string kernels: presence of character n-grams, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of n-grams (n from 1 to 3, blended) present in both, divided by
the root of the product of how many each has. N-grams are of code points and none is left out: those of
a text that no landmark has add nothing to any kernel and count in the divisor. Landmarks are sampled
documents; one ridge regression for each language (one against the rest) works on kernels with landmarks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_names, small_batches
from .toxicity import held_out

#: Texts of a batch, and entries of a matrix of presence that is held at once.
BATCH, HELD = 128, 1 << 22
#: Landmarks of all languages together, characters of a text that the fit reads, and entries of a table of n-grams by languages.
LANDMARKS, FIT_CHARS, TOLD = 2048, 8000, 1 << 24


@cache
def _letters() -> np.ndarray:
    """For each code point its number plus 1 if it is a letter, else 0."""
    return np.fromiter((i + 1 if chr(i).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """The distinct 1- to 3-grams of a lower-cased text as numbers; a run of what is no letter is one mark, as are the ends.

    A character takes 21 bits, the mark is 1 and letters are above it, so no two n-grams share a number.
    """
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] + 1
    two = (c[:-1] << 21) | c[1:]
    return np.unique(np.concatenate([c, two, (two[:-1] << 21) | c[2:]]))


@dataclass
class Kernel:
    """All n-grams of the landmarks, which landmarks have each (grams' rows of `marks` from `starts` on), and what each landmark gives each language.

    told has what each n-gram gives each language, the sum over its landmarks, where that table is small; else
    kernels are computed and weighted. Both are the same sums in another order.
    """

    grams: np.ndarray
    starts: np.ndarray
    marks: np.ndarray
    scale: np.ndarray
    names: list[str]
    weight: np.ndarray | None = None
    told: np.ndarray | None = None

    @classmethod
    def of(cls, codes: list[np.ndarray], names: list[str]) -> Kernel:
        """The inverted index of landmarks' n-grams."""
        flat = np.concatenate(codes)
        owner = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        order = np.argsort(flat, kind="stable")
        grams, starts = np.unique(flat[order], return_index=True)
        return cls(grams, np.concatenate([starts, [len(flat)]]), owner[order], np.array([1 / math.sqrt(len(c)) for c in codes]), names)

    def weighted(self, weight: np.ndarray) -> None:
        """Take landmarks' weights on: a row for each, a column for each language."""
        self.weight = weight * self.scale[:, None]
        if len(self.grams) * weight.shape[1] <= TOLD:
            step, parts = max(1, HELD // weight.shape[1]), []
            for i in range(0, len(self.grams), step):  # each has one landmark at least
                at = self.starts[i : min(i + step, len(self.grams))]
                end = self.starts[min(i + step, len(self.grams))]
                parts.append(np.add.reduceat(self.weight[self.marks[at[0] : end]], at - at[0], axis=0).astype(np.float32))
            self.told = np.concatenate(parts)

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Places of those n-grams that some landmark has."""
        at = np.searchsorted(self.grams, codes)
        at[at == len(self.grams)] = 0
        return at[self.grams[at] == codes]

    def kernels(self, codes: np.ndarray) -> np.ndarray:
        """How many n-grams a text shares with each landmark, over the root of how many it has."""
        at = self.found(codes)
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        rows = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(at) else np.empty(0, np.int64)
        return np.bincount(self.marks[rows], minlength=len(self.scale)) / math.sqrt(len(codes))

    def scores(self, texts: list[str]) -> np.ndarray:
        """A column for each language: near 1 for it, near -1 for others."""
        out = np.zeros((len(texts), len(self.names)))
        for i, text in enumerate(texts):
            codes = gram_codes(text)
            out[i] = self.told[self.found(codes)].sum(0, dtype=np.float64) / math.sqrt(len(codes)) if self.told is not None else self.kernels(codes) @ self.weight
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(texts: list[str], names: list[str], landmarks: int = 64, ridge: float = 1e-2) -> Kernel | None:
    """Fit on texts in random order and their languages: the first `landmarks` of each language (fewer where
    LANDMARKS bounds those of all languages), all texts for the regression; only a text's first FIT_CHARS characters.

    None where there is nothing to learn. Landmarks are kept as sorted n-grams and an inverted index, so memory
    goes with how many n-grams they have and not with landmarks times all n-grams.
    """
    known = sorted(set(names))
    if not known:
        return None
    of = {k: [i for i, m in enumerate(names) if m == k] for k in known}
    each = max(1, min(landmarks, LANDMARKS // len(known)))
    codes = {i: gram_codes(texts[i][:FIT_CHARS]) for own in of.values() for i in own[:each]}
    model = Kernel.of(list(codes.values()), known)
    base = np.stack([model.kernels(c) for c in codes.values()]) * model.scale
    value, vector = np.linalg.eigh((base + base.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.concatenate([np.stack([model.kernels(codes[i] if i in codes else gram_codes(texts[i][:FIT_CHARS])) for i in range(at, min(at + BATCH, len(texts)))]) * model.scale @ root for at in range(0, len(texts), BATCH)])
    y = np.array([[1.0 if m == k else -1.0 for k in known] for m in names])
    weight = np.array([1.0 / len(of[m]) for m in names])[:, None] * len(names) / len(known)
    alpha = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]) * len(names) / 100, phi.T @ (y * weight))
    model.weighted(root @ alpha)
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, most: int = 8000, seed: int = 6) -> tuple[list[str], list[str]]:
    """Beginnings of texts with a letter and their languages, held-out rows apart, in an order drawn by seed.

    Of each language per_language documents at most, of all together `most`: first one of each
    language, then a second, and so on. Of each text FIT_CHARS characters: the fit is bounded by
    `most` times as many, and no language goes for the length of its texts. Ids are ranked, and
    cut in each task before they are shuffled; only texts of chosen rows move.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    keyed = rows.select("_lang", F.xxhash64(F.lit(seed), "_id", "_text").alias("_key"))
    for own in (["_lang", F.pmod("_key", F.lit(256))], ["_lang"]):  # a hot language is cut in parts first
        rank = F.row_number().over(Window.partitionBy(*own).orderBy("_key"))
        keyed = keyed.withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    chosen = [r["_key"] for r in keyed.orderBy("_rank", "_key").limit(most).collect()]
    if not chosen:
        return [], []
    picked = docs.sparkSession.createDataFrame([(k,) for k in sorted(set(chosen))], "_key long")
    cut = F.substring(F.regexp_replace("_text", r"^[^\p{L}]+", " "), 1, FIT_CHARS)
    got = rows.withColumn("_key", F.xxhash64(F.lit(seed), "_id", "_text")).join(F.broadcast(picked), "_key").dropDuplicates(["_key"]).select("_key", cut.alias("_text"), "_lang").collect()  # at most `most` rows
    got = sorted((r for r in got if has_letter(r["_text"])), key=lambda r: r["_key"])
    return [r["_text"] for r in got], [r["_lang"] for r in got]


def _predict(model: Kernel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            said, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for at in range(0, batch.num_rows, BATCH):
                part = [t.as_py() for t in texts[at : at + BATCH]]
                own = [i for i, t in enumerate(part) if t and has_letter(t)] if model else []
                if not own:
                    continue
                s = model.scores([part[i] for i in own])
                best = s.argmax(1)
                for i, b, v in zip(own, best.tolist(), s[np.arange(len(own)), best].tolist()):
                    said[at + i], scores[at + i] = model.names[b], min(1.0, max(0.0, (v + 1) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def _model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> Kernel | None:
    return fit(*sample(docs, id_col, text_col, lang_col, per_language))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, keep_text: bool = False) -> DataFrame:
    """One row for each document: id_col, held_out, lang_pred, score; with keep_text all its columns too.

    The model is fitted on at most per_language documents of each language that are not held out (see
    `sample` for the bounds on all of them together); the prediction reads the text alone, whole,
    however long it is. Null texts and texts without a letter are `und` with score 0, as are all where
    no language can be learned. A tie goes to the language first in order. A null id is held out as empty
    text would be. Repeated rows stay rows, columns of docs keep their names (ours get underscores
    before them where they clash); an empty table gives an empty table. Texts are read twice, for the
    sample and for the predictions; only ids' hashes and the sample are shuffled.
    """
    small_batches(docs.sparkSession)
    model = _model(docs, id_col, text_col, lang_col, per_language)
    out, said, score = distinct_names(docs.columns if keep_text else [id_col], "held_out", "lang_pred", "score")
    if keep_text:
        return _with_columns(docs, model, id_col, text_col, said, score)
    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_predict(model), "id long, lang_pred string, score double")
    return made.select(F.col("id").alias(id_col), held_out("id").alias(out), F.col("lang_pred").alias(said), F.col("score").alias(score))


def _with_columns(docs: DataFrame, model: Kernel | None, id_col: str, text_col: str, said: str, score: str) -> DataFrame:
    from pyspark.sql.types import DoubleType, StringType, StructType

    at = [docs.columns.index(id_col), docs.columns.index(text_col)]
    predict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (got,) = predict(iter([pa.RecordBatch.from_arrays([batch.column(i) for i in at], ["id", "text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, got.column(1), got.column(2)], [*batch.schema.names, said, score])

    schema = StructType([*docs.schema.fields]).add(said, StringType()).add(score, DoubleType())
    return docs.mapInArrow(run, schema)
