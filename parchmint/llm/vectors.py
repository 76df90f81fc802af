"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Vectors fall into the list of their nearest coarse centroid; a member keeps its residual's codes, one
for each subspace. A vector visits its own list and those whose border is near it, compares by table
lookups (its own residual against all codewords) and reranks by exact cosine what the lookups leave.

One index serves vectors of every length: it reads the first `dim` components of the unit vector, filled
up with zeros. That never makes two vectors of one length farther apart, so no bound loses a neighbour;
only vectors of one length meet, and cosines are those of whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, saved
from .graph import components

#: Members and visitors of a list that meet in one task; longer lists are cut into pairs of chunks.
MEMBERS, VISITORS = 1024, 4096
#: Entries of a matrix of distances that is held at once.
HELD = 1 << 22


@dataclass
class Index:
    """Coarse centroids (lists, dim) and codewords (subspaces, words, dim / subspaces)."""

    coarse: np.ndarray
    words: np.ndarray
    radius: float
    margin: float

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and how far each is from what its codes say."""
        s, _, width = self.words.shape
        codes, left = np.empty((len(residual), s), np.uint8), np.zeros(len(residual))
        for i in range(s):
            part, book = residual[:, i * width : (i + 1) * width], self.words[i]
            codes[:, i] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            left += ((part - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and a matrix of the lists it visits.

        A list is visited if the plane between its centroid and the nearest one is within the margin.
        Neighbours on two sides of a plane lie within the radius of each other, so one of them lies within
        half of it of the plane: with a margin of half the radius at least one visits the other's list.
        """
        d = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1))
        own = d.argmin(1)
        between = (self.coarse**2).sum(1)
        apart = np.sqrt(np.maximum(1e-12, between[own][:, None] - 2 * self.coarse[own] @ self.coarse.T + between))
        visit = d - d[np.arange(len(x)), own][:, None] <= 2 * self.margin * apart + 1e-9
        visit[np.arange(len(x)), own] = True
        return own, visit

    def read(self, x: np.ndarray) -> np.ndarray:
        """What the index reads of unit rows."""
        dim = self.coarse.shape[1]
        return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))

    def near(self, visitors: np.ndarray, members: np.ndarray, codes: np.ndarray, err: np.ndarray, at: int, cosine: float) -> np.ndarray:
        """Which visitors (whole unit rows) are linked with which members of list `at`.

        A table distance differs from the true one by the member's coding error at most, so the bound
        radius + error keeps every neighbour; cosines in double precision decide.
        """
        s, _, width = self.words.shape
        r = self.read(visitors) - self.coarse[at]
        total = np.zeros((len(visitors), len(members)))
        for i in range(s):
            part, book = r[:, i * width : (i + 1) * width], self.words[i]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            total += table[:, codes[:, i]]
        v, m = np.nonzero(total <= (self.radius + err + 1e-9) ** 2)
        out = np.zeros(total.shape, bool)
        for i in range(0, len(v), 1 << 16):
            a, b = v[i : i + (1 << 16)], m[i : i + (1 << 16)]
            out[a, b] = np.einsum("ij,ij->i", visitors[a], members[b]) >= cosine
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c nearest to each row of x."""
    step, square = max(16, HELD // len(c)), (c**2).sum(1)
    return np.concatenate([(square - 2 * x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)])


def _means(x: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """k-means; an empty cell takes a random row."""
    c = x[draw.choice(len(x), k, len(x) < k)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        c[full] = sums / n[full][:, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[draw.integers(0, len(x), len(empty))]
    return c


def fit(x: np.ndarray, lists: int, cosine: float, margin: float | None = None, subspaces: int = 8, words: int = 256, seed: int = 4) -> Index:
    """Fit centroids and codewords on unit rows x."""
    draw = np.random.default_rng(seed)
    radius = float(np.sqrt(2 - 2 * cosine))
    dim = x.shape[1]
    while dim % subspaces:
        subspaces -= 1
    coarse = _means(x, lists, 6, draw)
    residual = x - coarse[_nearest(x, coarse)]
    width = dim // subspaces
    books = np.stack([_means(residual[:8192, i * width : (i + 1) * width], words, 5, draw) for i in range(subspaces)])
    return Index(coarse, books, radius, radius / 2 if margin is None else margin)


def _unit(raw: list[bytes]) -> np.ndarray:
    """Unit rows of vectors of one length."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where they can link with nothing."""
    for batch in batches:
        out = []
        for i, v in zip(batch.column(0), batch.column(2)):
            raw = None
            if i.is_valid and v.is_valid and not v.values.null_count and len(v.values):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
            out.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])


def _deal(index: Index, keys_only: bool):
    step = max(16, min(1024, HELD // len(index.coarse)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                raw = part.column(2).to_pylist()
                size = np.array(list(map(len, raw)))
                x = np.empty((len(raw), index.coarse.shape[1]))
                for n in np.unique(size):
                    same = np.flatnonzero(size == n)
                    x[same] = index.read(_unit([raw[i] for i in same]))
                own, visit = index.lists(x)
                v, c = np.nonzero(visit)
                row = np.concatenate([np.arange(len(x)), v])
                lists = np.concatenate([own, c]).astype(np.int32)
                kind = np.concatenate([np.zeros(len(x), np.int8), np.ones(len(v), np.int8)])
                visited = np.split(c.astype(np.int32), np.cumsum(visit.sum(1))[:-1])
                seen = [y.tobytes() for y in visited] + [y.tobytes() for y in own.astype(np.int32)[v]]
                take = pa.array(row)
                label = part.column(1).take(take)
                if keys_only:
                    yield pa.RecordBatch.from_arrays([label, pa.array(lists), pa.array(kind)], ["label", "list", "kind"])
                else:
                    yield pa.RecordBatch.from_arrays([label, pa.array(lists), pa.array(kind), part.column(0).take(take), part.column(3).take(take), part.column(2).take(take), pa.array(seen, pa.binary())], ["label", "list", "kind", "rep", "m", "vec", "seen"])

    return run


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (row id, column id) that connect what the matrix connects."""
    a, b = [], []
    live = np.flatnonzero(linked.any(1))
    linked = linked[live]
    free_r, free_c = np.ones(len(live), bool), np.ones(linked.shape[1], bool)
    for start in range(len(live)):
        if not free_r[start]:
            continue
        queue = [start]
        free_r[start] = False
        while queue:
            r = queue.pop()
            new_c = np.flatnonzero(linked[r] & free_c)
            free_c[new_c] = False
            for c in new_c.tolist():
                a.append(int(rows[live[r]]))
                b.append(int(cols[c]))
                new_r = np.flatnonzero(linked[:, c] & free_r)
                free_r[new_r] = False
                a += rows[live[new_r]].tolist()
                b += [int(cols[c])] * len(new_r)
                queue += new_r.tolist()
    return a, b


def _compare(index: Index, cosine: float):
    def block(at: int, kind: list[int], rep: list[int], m: list[int], vec: list[bytes], seen: list[bytes]) -> tuple[list, list, list]:
        """seen: the lists that a member visits, the own list of a visitor."""
        member = np.array(kind) == 0
        if member.all() or not member.any():
            return [], [], []
        x, rep, m = _unit(vec), np.array(rep), np.array(m)
        mem, vis = x[member], x[~member]
        codes, err = index.encode(index.read(mem) - index.coarse[at])
        homes, home = np.unique(np.frombuffer(b"".join(y for y, k in zip(seen, kind) if k), np.int32), return_inverse=True)
        blind = np.stack([~np.isin(homes, np.frombuffer(y, np.int32)) for y, k in zip(seen, kind) if not k])
        back = np.zeros(len(mem), np.int64)
        a, b, n = [], [], []
        for i in range(0, len(vis), 512):
            linked = index.near(vis[i : i + 512], mem, codes, err, at, cosine)
            own = rep[~member][i : i + 512]
            count = linked @ m[member]
            full = np.flatnonzero(count)
            a += own[full].tolist()
            b += [None] * len(full)
            n += count[full].tolist()
            back += m[~member][i : i + 512] @ (linked & blind[:, home[i : i + 512]].T)
            linked &= own[:, None] != rep[member][None]
            p, q = _forest(linked, own, rep[member])
            a += p
            b += q
            n += [0] * len(p)
        full = np.flatnonzero(back)
        return a + rep[member][full].tolist(), b + [None] * len(full), n + back[full].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket (label, list, i, j); a bucket may go on in the next batch."""
        key, held = None, [[], [], [], [], []]

        def out() -> pa.RecordBatch:
            a, b, n = block(key[1], *held) if held[0] else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if row[:4] != key:
                    yield out()
                    key, held = row[:4], [[], [], [], [], []]
                for x, y in zip(held, row[4:]):
                    x.append(y)
        yield out()

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98, lists: int | None = None, margin: float | None = None, sample: int | None = None, dim: int | None = None) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null (label_col None: all of them) and
    their lengths are equal. A vector that is null, empty, zero, holds null or non-finite components,
    or has no id links with nothing: n_links 0, its own component. Equal vectors are one class and link
    with each other; n_links counts rows. component_id is the smallest id reachable. Repeated rows count
    as vectors. Other columns are not read. An empty table gives an empty table.

    Centroids and codewords are fitted on about `sample` vectors (default: 16,384, or four for a list
    where there are more) and their size depends on `lists` alone: one for 40 vectors up to 4,096, and
    beyond that as many as the root of their number, so that work per vector grows as that root. Every
    vector is indexed, by its first `dim` components (default: the commonest length). margin decides which lists are
    visited: half the link radius by default, with which at least one end of a link visits the other's
    list; where only one does, the link is counted for the other end too. Less than that loses links. A list or its visitors, when hot, are cut into chunks that meet in pairs;
    links are counted where they are found and only a spanning forest of them is kept.
    """
    names = distinct_names([id_col], "n_links", "component_id", "kept")
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(_bytes, "id long, label string, vec binary").withColumn("label", F.concat(F.octet_length("vec").cast("string"), F.lit(":"), "label"))
    reps = saved(rows.where("vec is not null and label is not null").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")).select("rep", "label", "vec", "m"), "classes")
    n = reps.count()
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias(names[0]), F.col("id").alias(names[1]), F.lit(True).alias(names[2]))
    if dim is None:
        dim = reps.groupBy((F.octet_length("vec") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()["d"]
    lists = lists or max(1, min(4096, n // 40), math.isqrt(n) if n > 4096**2 else 0)
    share = min(1.0, (sample or max(16_384, 4 * lists)) / n)
    drawn = reps.where(F.pmod(F.xxhash64(F.lit(4), "vec"), F.lit(1 << 30)) < share * (1 << 30)).select("vec").orderBy("vec").collect()
    drawn = [r["vec"] for r in drawn] or [r["vec"] for r in reps.select("vec").orderBy("vec").limit(1).collect()]
    of_dim = np.zeros((len(drawn), dim))
    for i, raw in enumerate(drawn):
        x = _unit([raw])[0, :dim]
        of_dim[i, : len(x)] = x
    index = fit(of_dim, lists, cosine, margin)
    kinds = reps.mapInArrow(_deal(index, True), "label string, list int, kind byte")
    sizes = kinds.groupBy("label", "list").agg(F.sum((F.col("kind") == 0).cast("int")).alias("nm"), F.sum(F.col("kind").cast("int")).alias("nv")).where("nm > 0")
    dealt = reps.mapInArrow(_deal(index, False), "label string, list int, kind byte, rep long, m long, vec binary, seen binary").join(sizes, ["label", "list"])
    km, kv = F.ceil(F.col("nm") / MEMBERS).cast("int"), F.ceil(F.col("nv") / VISITORS).cast("int")
    h = F.xxhash64("rep")
    pairs = F.when(F.col("kind") == 0, F.transform(F.sequence(F.lit(0), kv - 1), lambda j: F.struct(F.pmod(h, km).cast("int").alias("i"), j.alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), km - 1), lambda i: F.struct(i.alias("i"), F.pmod(h, kv).cast("int").alias("j"))))
    spread = dealt.withColumn("p", F.explode(pairs)).select("label", "list", "p.i", "p.j", "kind", "rep", "m", "vec", "seen")
    found = saved(spread.repartition("label", "list", "i", "j").sortWithinPartitions("label", "list", "i", "j").mapInArrow(_compare(index, cosine), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    told = reps.join(counts, "rep", "left").join(roots, "rep", "left").select("label", "vec", (F.coalesce("n", "m") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    out = rows.join(told, ["label", "vec"], "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias(names[0]), component.alias(names[1]), (F.col("id").eqNullSafe(component)).alias(names[2]))
