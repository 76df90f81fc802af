"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Tokens are the words of a line. Labels are given for documents only, so tokens are labelled first: a
token of a toxic document is toxic if its word or one of its beginnings is found in far more toxic
documents than chance allows. The field has two tags; its features are those words and beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, small_batches

_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_CACHE = 500_000
#: Lines are cut into segments of so many tokens for fitting only.
_SEGMENT = 64


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(word: str, low: int = 4, high: int = 7) -> list[str]:
    """A bare word and its beginnings, marked so that a word and a beginning differ."""
    return [word + "$", *[word[:n] for n in range(low, min(high, len(word)) + 1)]]


@dataclass
class Field:
    """A fitted field: weights of the toxic tag, transitions, and the map from marginals to a score."""

    weights: dict[str, float]
    bias: float = -4.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self) -> None:
        self.plain: set[str] = set()
        self.flat: dict[int, float] = {}

    def emission(self, token: str) -> float:
        """The toxic tag's score of a lower-cased token beside the bias, 0.0 for one without features."""
        get = self.weights.get
        word = token if token.isalpha() else _EDGES.sub("", token)
        if not word:
            return 0.0
        out = get(word + "$", 0.0)
        for n in range(4, min(7, len(word)) + 1):
            out += get(word[:n], 0.0)
        return out

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """The probability of the toxic tag at each token of one line, by forward and backward passes."""
        n = len(scores)
        oo, ot, to, tt = np.exp(self.move).ravel().tolist()
        e = np.exp(np.clip(scores + self.bias, -50, 50)).tolist()
        ahead = [0.0] * n  # odds of the toxic tag given what came before
        a = e[0]
        ahead[0] = a
        for i in range(1, n):
            a = e[i] * (ot + a * tt) / (oo + a * to)
            ahead[i] = a
        out = [0.0] * n
        b = 1.0  # ratio of what follows after the toxic tag and after the other
        for i in range(n - 1, -1, -1):
            odds = ahead[i] * b
            out[i] = odds / (1 + odds)
            x = e[i] * b
            b = (to + tt * x) / (oo + ot * x)
        return np.array(out)

    def blank(self, n: int) -> float:
        """Expected toxic tokens of a line of n tokens without features."""
        if n not in self.flat:
            known = float(self.marginals(np.zeros(n)).sum())
            if len(self.flat) >= 100_000:
                return known
            self.flat[n] = known
        return self.flat[n]

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Expected toxic tokens of a text, and spans (start, end, marginal) of tokens likelier toxic than not."""
        lines = [x.split() for x in text.lower().split("\n")]
        hits = {}
        for token in set().union(*lines) - self.plain:
            if known := self.emission(token):
                hits[token] = known
            elif len(token) <= 32:
                if len(self.plain) >= _CACHE:
                    self.plain.clear()
                self.plain.add(token)
        if not hits:
            return sum(map(self.blank, filter(None, map(len, lines)))), []
        expected, spans, at = 0.0, [], 0
        for line, tokens in zip(text.split("\n"), lines):
            if not hits.keys().isdisjoint(tokens):
                m = self.marginals(np.array([hits.get(t, 0.0) for t in tokens]))
                expected += float(m.sum())
                if m.max() >= 0.5:
                    found = [x.span() for x in _TOKEN.finditer(line)]
                    spans += [(at + found[i][0], at + found[i][1], float(m[i])) for i in np.flatnonzero(m >= 0.5) if i < len(found)]
            elif tokens:
                expected += self.blank(len(tokens))
            at += len(line) + 1
        return expected, spans

    def score(self, expected: float) -> float:
        return float(1 / (1 + np.exp(-(self.scale[0] + self.scale[1] * np.log(expected + 1e-3)))))


def telling(toxic: Iterable[set[str]], clean: Iterable[set[str]], ratio: float = 8.0, doubt: float = 0.01) -> set[str]:
    """Features found in toxic documents `ratio` times as often as in clean ones, beyond chance.

    Beyond chance: the likelihood ratio exceeds what the best of all features would reach by luck with
    probability doubt.
    """
    t, c = Counter[str](), Counter[str]()
    nt = nc = 0
    for x in toxic:
        t.update(x)
        nt += 1
    for x in clean:  # only what toxic documents have matters
        c.update(x & t.keys())
        nc += 1
    least = 2 * np.log(max(1, len(t)) / doubt)

    def part(k: float, n: float, p: float) -> float:
        return k * np.log(p) + (n - k) * np.log1p(-p)

    out = set()
    for f, k in t.items():
        j = c.get(f, 0)
        if k < 3 or k / nt < ratio * (j + 0.5) / (nc + 1):
            continue
        p, q, r = min(k / nt, 1 - 1e-9), max(min(j / max(nc, 1), 1 - 1e-9), 1e-9), min((k + j) / (nt + nc), 1 - 1e-9)
        if 2 * (part(k, nt, p) + part(j, nc, q) - part(k, nt, r) - part(j, nc, r)) >= least:
            out.add(f)
    return out


def unlike(texts: list[str], bands: int = 8, rows: int = 4) -> list[str]:
    """Texts without near copies of earlier ones: copies would make their chance words look telling.

    A text goes if it shares a band of minimum hashes of its words with one that stays.
    """
    draw = np.random.default_rng(3)
    a, b = (draw.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1) for _ in "ab")
    seen: set[tuple[int, bytes]] = set()
    out = []
    for text in texts:
        words = set(text.lower().split())
        if not words:
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        low = np.concatenate([(h[i : i + 4096, None] * a + b).min(0, keepdims=True) for i in range(0, len(h), 4096)]).min(0)
        keys = {(i, low[i * rows : (i + 1) * rows].tobytes()) for i in range(bands)}
        if not keys & seen:
            out.append(text)
            seen |= keys
    return out


def fit(toxic: list[str], clean: list[str], heavy: float = 1.0, rounds: int = 40, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Fit the field on texts of toxic and clean documents; without toxic ones every score stays low.

    heavy is how many clean documents one of the sample stands for, as a multiple of the toxic ones.
    """
    toxic, clean = unlike(toxic), unlike(clean)
    told = telling(map(_words, toxic), map(_words, clean))
    names = {f: i for i, f in enumerate(sorted(told))}
    lines, tags = [], []  # per line: feature indices of each token, labels
    blanks: Counter[int] = Counter()
    memo: dict[str, tuple[int, ...]] = {}

    def found(token: str) -> tuple[int, ...]:
        if token not in memo:
            word = _EDGES.sub("", token)
            memo[token] = tuple(names[f] for f in features(word) if f in names) if word else ()
        return memo[token]

    for label, texts in ((1, toxic), (0, clean)):
        for text in texts:
            for line in text.lower().split("\n"):
                own = [found(t) for t in line.split()]
                for i in range(0, len(own), _SEGMENT):
                    part = own[i : i + _SEGMENT]
                    if any(part):
                        lines.append(part)
                        tags.append([label if x else 0 for x in part])
                    else:
                        blanks[len(part)] += 1
    model = Field({})
    if not names:
        model.scale = (-3.0, 0.0)
        return model
    _descend(model, names, lines, tags, blanks, rounds, rate, ridge)
    x = np.array([np.log(model.read(t)[0] + 1e-3) for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    model.scale = _logistic(x, y, np.where(y > 0, 1.0, heavy))
    return model


def _words(text: str) -> set[str]:
    return {f for w in {_EDGES.sub("", t) for t in set(text.lower().split())} if w for f in features(w)}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the slope stays positive."""
    z, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 1e-3)


def _descend(model: Field, names: dict[str, int], lines: list, tags: list, blanks: Counter[int], rounds: int, rate: float, ridge: float) -> None:
    """Maximum likelihood by Adam; forward and backward run over all lines at once, padded by length."""
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    groups = []
    for at in range(0, len(order), 512):
        own = order[at : at + 512]
        width = max(len(lines[i]) for i in own)
        mask, gold = np.zeros((len(own), width), bool), np.zeros((len(own), width))
        rows, cols, feats = [], [], []
        for r, i in enumerate(own):
            n = min(width, len(lines[i]))
            mask[r, :n] = True
            gold[r, :n] = tags[i][:n]
            for c, fs in enumerate(lines[i][:n]):
                rows += [r] * len(fs)
                cols += [c] * len(fs)
                feats += fs
        groups.append((mask, gold, np.array(rows, int), np.array(cols, int), np.array(feats, int), np.ones(len(own))))
    sizes = sorted(blanks)
    for at in range(0, len(sizes), 512):
        own = sizes[at : at + 512]
        mask = np.arange(own[-1])[None] < np.array(own)[:, None]
        none = np.empty(0, int)
        groups.append((mask, np.zeros(mask.shape), none, none, none, np.array([float(blanks[n]) for n in own])))
    k = len(names)
    theta = np.concatenate([np.full(k, 2.0), [-4.0], np.zeros(3)])  # weights, bias, O to T, T to O, T to T
    m = v = np.zeros(k + 4)
    total = sum(float((g[0].sum(1) * g[5]).sum()) for g in groups)
    for t in range(1, rounds + 1):
        grad = np.zeros(k + 4)
        move = np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]])
        for mask, gold, rows, cols, feats, heavy in groups:
            e = np.full(mask.shape, theta[k])
            np.add.at(e, (rows, cols), theta[feats])
            p, pair = _passes(e, mask, move)
            diff = np.where(mask, (gold - p) * heavy[:, None], 0.0)
            grad[k] += diff.sum()
            np.add.at(grad, feats, diff[rows, cols])
            both = mask[:, 1:] * heavy[:, None]
            g0, g1 = gold[:, :-1], gold[:, 1:]
            grad[k + 1] += (((1 - g0) * g1 - pair[0]) * both).sum()
            grad[k + 2] += ((g0 * (1 - g1) - pair[1]) * both).sum()
            grad[k + 3] += ((g0 * g1 - pair[2]) * both).sum()
        grad[:k] -= ridge * theta[:k] * 1.0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8 * total)
        theta = np.clip(theta, -12, 12)
    model.weights = {f: float(theta[i]) for f, i in names.items()}
    model.bias = float(theta[k])
    model.move = np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]])
    model.__post_init__()


def _passes(e: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Marginals of the toxic tag and of the moves O to T, T to O and T to T, for padded lines."""
    w = np.exp(np.clip(e, -50, 50))
    (oo, ot), (to, tt) = np.exp(move)
    n = e.shape[1]
    ahead, behind = np.empty_like(w), np.ones_like(w)
    ahead[:, 0] = w[:, 0]
    for i in range(1, n):
        a = ahead[:, i - 1]
        ahead[:, i] = w[:, i] * (ot + a * tt) / (oo + a * to)
    for i in range(n - 2, -1, -1):
        x = w[:, i + 1] * behind[:, i + 1]
        behind[:, i] = np.where(mask[:, i + 1], (to + tt * x) / (oo + ot * x), 1.0)
    odds = ahead * behind
    p = np.where(mask, odds / (1 + odds), 0.0)
    a, x = ahead[:, :-1], w[:, 1:] * behind[:, 1:]
    z = oo + ot * x + a * (to + tt * x)
    return p, (ot * x / z, a * to / z, a * tt * x / z)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", seed: int = 5, most_bytes: int = 128 << 20) -> tuple[list[str], list[str], float]:
    """Texts of about per_class (toxic, clean) labelled documents that are not held out, by seeded hash,
    and how much heavier a clean one counts.

    Together they have most_bytes at most: where they would have more, the longest are left out of the fit.

    Repeated labels of an id count by their mean. Null labels are none. The expected number of rows is
    the bound; ids that are sampled are broadcast (16 bytes each).
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    heavy = max(1.0, n.get(0, 0) / per_class[1]) / max(1.0, n.get(1, 0) / per_class[0])
    share = F.when(F.col("_y") == 1, F.lit(min(1.0, per_class[0] / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, per_class[1] / max(1, n.get(0, 0)))))
    picked = known.where(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id").select("_y", "_id", "_text")
    size = F.ceil(F.log2(F.octet_length("_text") + 1.0)).cast("int")  # texts of up to 2^size bytes
    longest, total = 0, 0
    for r in sorted(rows.groupBy(size.alias("size")).agg(F.sum(F.octet_length("_text")).alias("bytes")).collect(), key=lambda r: r["size"]):
        total += r["bytes"]
        if total > most_bytes:
            break
        longest = r["size"]
    rows = rows.where(size <= longest).collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return [r["_text"] for r in rows if r["_y"] == 1], [r["_text"] for r in rows if r["_y"] == 0], heavy


def _tag(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, spans, expected = [], [], []
            for text in batch.column(1):
                e, own = model.read(text.as_py() or "")
                scores.append(model.score(e))
                expected.append(e)
                spans.append([{"start": a, "end": b, "p": p} for a, b, p in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(expected, pa.float64()), pa.array(spans, kind)], ["id", "score", "expected", "spans"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, per_class: tuple[int, int] = (2000, 4000)) -> DataFrame:
    """One row for each document: id_col, held_out, score, predicted, expected_tokens, spans.

    The score comes from the text alone; spans are code point offsets [start, end) of tokens whose
    marginal is 0.5 or more. Null and empty texts have no token and get the lowest score. The model is
    fitted on a sample bounded by per_class (toxic, clean) documents that are not held out; without
    toxic labels nothing is predicted. Repeated rows stay rows; an empty table gives an empty table.
    Nothing is shuffled but labels: scoring is one pass over the texts.
    """
    small_batches(docs.sparkSession)
    model = fit(*sample(docs, labels, label_col, per_class, id_col, text_col))
    out, score, predicted, expected, spans = distinct_names([id_col], "held_out", "score", "predicted", "expected_tokens", "spans")
    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_tag(model), "id long, score double, expected double, spans array<struct<start:int,end:int,p:double>>")
    return made.select(F.col("id").alias(id_col), held_out("id").alias(out), F.col("score").alias(score), (F.col("score") >= threshold).cast("int").alias(predicted), F.col("expected").alias(expected), F.col("spans").alias(spans))
