"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity
flows from patterns to source quotas; the r-th repetition of a document costs r, so the cost is
convex and repeats are used only where first uses run out. Seeded documents then fill each
pattern's flows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, distinct_names, running_total, saved

#: Patterns come to the driver; beyond this many the mix is refused instead of growing with the data.
MAX_PATTERNS = 50_000


def fill_targets(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; a share stops at cap times its size, its excess goes on by weight."""
    out, open_ = [0.0] * len(sizes), {i for i in range(len(sizes)) if weights[i] > 0}
    left = total
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * scale > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * scale
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], levels: int) -> list[list[dict[int, int]]]:
    """Min-cost flow from patterns to sources: flows[r][p][s] words of pattern p's r-th use for source s.

    Cost sits only on the arcs into a pattern and grows with the level, so shortest augmenting paths
    come level by level: a maximum flow over the arcs up to r, then the arcs of level r + 1 open.
    No path back through the start lowers an earlier level, hence each level's flow is final.
    """
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, c: int) -> int:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((c, 0))
        return len(to) - 2

    into = [arc(start, p, 0) for p in range(n)]
    most = sum(capacity) * levels + 1
    across = [{s: arc(p, n + s, most) for s in own} for p, own in enumerate(members)]
    for s in range(m):
        arc(n + s, end, quota[s])
    used = [0] * n
    flows: list[list[dict[int, int]]] = []
    sent = [dict.fromkeys(own, 0) for own in members]
    for _ in range(levels):
        for p in range(n):
            room[into[p]] += capacity[p] - (room[into[p]] if flows else 0)
        while True:  # Dinic: level graph, then a blocking flow
            depth = [-1] * len(graph)
            depth[start] = 0
            queue = deque([start])
            while queue:
                for e in graph[a := queue.popleft()]:
                    if room[e] and depth[to[e]] < 0:
                        depth[to[e]] = depth[a] + 1
                        queue.append(to[e])
            if depth[end] < 0:
                break
            at = [0] * len(graph)
            path: list[int] = []
            here = start
            while True:
                if here == end:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    path, here = [], start
                    continue
                while at[here] < len(graph[here]) and not (room[e := graph[here][at[here]]] and depth[to[e]] == depth[here] + 1):
                    at[here] += 1
                if at[here] < len(graph[here]):
                    path.append(graph[here][at[here]])
                    here = to[path[-1]]
                elif path:
                    here = to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break
        now = [room[into[p] ^ 1] for p in range(n)]
        amount = [now[p] - used[p] for p in range(n)]
        used = now
        level = []
        for p in range(n):  # what this level sends on; an earlier level's words may have been rerouted
            total = {s: room[e ^ 1] for s, e in across[p].items()}
            left, own = amount[p], {}
            for s, x in total.items():
                take = min(left, max(0, x - sent[p][s]))
                own[s] = take
                sent[p][s] += take
                left -= take
            level.append(own)
        flows.append(level)
    return flows


def mix(
    docs: DataFrame,
    members: Column,
    size: Column,
    weight_cycle: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_uses: int = 2,
    seed: int = 1,
    id_col: str = "doc_id",
    buckets: int = 4096,
    ties: Sequence[str] = (),
) -> DataFrame:
    """How often each document enters a mix whose sources come near target sizes.

    members is an array<string> of the sources a document belongs to; null stands for a source of its
    own, last in order, as does a null element. size is a long, null counts as 0. Sources in order of
    code points get weight_cycle repeating and share `share` times all sizes; a target stops at
    max_uses times its source's size and the excess is shared again.

    Returns all columns of docs and _size, _uses, _taken (long: size times uses) and _targets, an
    array of structs (source, source_size, target) of the document's sources. Documents are taken
    whole: a source misses its target by half a document at most for each pattern and level. Repeated
    rows are documents of their own. Documents without words are never taken, an empty table gives an
    empty table. The order that decides is xxhash64(seed, id), then id, size and the columns of ties: reruns agree. Fails beyond
    MAX_PATTERNS patterns instead of collecting more.

    The text is read once; what is shuffled is (id, pattern, size). Patterns are aggregated before the
    shuffle, and a pattern with most documents is spread over `buckets` windows.
    """
    spark = docs.sparkSession
    size_c, pattern, before, uses, taken, targets, pid, cuts = distinct_names(docs.columns, "_size", "_pattern", "_before", "_uses", "_taken", "_targets", "_pid", "_cuts")
    marked = F.transform(F.coalesce(members, F.array(F.lit(None).cast("string"))), lambda x: F.when(x.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), x)))
    sized = docs.withColumns({size_c: F.coalesce(size, F.lit(0)).cast("long"), pattern: F.array_sort(F.array_distinct(marked))})
    groups = sized.groupBy(pattern).agg(F.sum(size_c).alias("cap")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = sorted(((tuple(r[0]), r["cap"]) for r in groups), key=lambda x: [s.encode("utf-8") for s in x[0]])
    sources = sorted({s for own, _ in found for s in own}, key=lambda s: s.encode("utf-8"))  # UTF-8 order is code point order
    index = {s: i for i, s in enumerate(sources)}
    own = [[index[s] for s in names] for names, _ in found]
    caps = [cap for _, cap in found]
    sizes = [0] * len(sources)
    for cap, ids in zip(caps, own):
        for i in ids:
            sizes[i] += cap
    weights = [weight_cycle[i % len(weight_cycle)] for i in range(len(sources))]
    goal = fill_targets(sizes, weights, share * sum(caps), max_uses)
    flows = route(caps, own, [round(x) for x in goal], max_uses)
    rows = []
    for p, (names, _) in enumerate(found):
        ends = [sum(level[p].values()) for level in flows]
        rows.append((p, list(names), ends, [(s[1:] if s[0] == "0" else None, sizes[index[s]], float(goal[index[s]])) for s in names]))
    table = spark.createDataFrame(rows, f"`{pid}` int, _names array<string>, `{cuts}` array<bigint>, `{targets}` array<struct<source:string,source_size:bigint,target:double>>")
    told = sized.join(F.broadcast(table), F.col(pattern) == F.col("_names"), "left").drop("_names", pattern)  # at most MAX_PATTERNS rows
    order = [F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col), F.col(size_c), *map(F.col, ties)]
    scanned = running_total(told, [pid], order, order[0], F.col(size_c), before, buckets)
    middle = 2 * F.col(before) + F.col(size_c)
    times = F.aggregate(F.transform(F.col(cuts), lambda c: ((middle < 2 * c) & (F.col(size_c) > 0)).cast("int")), F.lit(0), lambda a, x: a + x)
    return scanned.withColumn(uses, F.coalesce(times, F.lit(0))).withColumn(taken, F.col(size_c) * F.col(uses)).drop(pid, cuts, before)


def mix_by_source(docs: DataFrame, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """mix() of documents that belong to one source each, sized by words; keeps ids and sizes, not texts."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
    id_col = options.get("id_col", "doc_id")
    small = saved(docs.select(F.col(id_col), F.col(source_col).alias("_source"), size.cast("long").alias("_words")), "mix")
    return mix(small, F.array(F.col("_source")), F.col("_words"), **options)


def mixed_rows(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 1, **options) -> DataFrame:
    """The mix of mix_by_source itself: rows of docs as often as it takes them, with docs' columns alone; unused ones go.

    Rows are told apart by two 64-bit hashes of all their columns, so rows that share an id or have none are
    taken each as often as they should. Rows equal in all columns share what is taken of them evenly, the rest
    goes to some of them. Null texts have no words and go, as does an empty table. Texts are shuffled once.
    """
    one, two, n, k = distinct_names(docs.columns, "_key1", "_key2", "_n", "_k")
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    keyed = docs.select("*", F.xxhash64(*parts).alias(one), F.xxhash64(F.lit(seed), *parts).alias(two))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    small = saved(keyed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(one).alias("key1"), F.col(two).alias("key2"), size.alias("words")), "mix")
    told = mix(small, F.array(F.col("source")), F.col("words"), seed=seed, id_col="id", ties=("key1", "key2"), **options).where("_uses > 0")
    uses = told.groupBy(F.col("key1").alias(one), F.col("key2").alias(two)).agg(F.sum("_uses").alias(n))
    rows = small.groupBy(F.col("key1").alias(one), F.col("key2").alias(two)).agg(F.count("*").alias(k))
    joined = keyed.join(uses.join(rows, [one, two]), [one, two])
    first = F.row_number().over(Window.partitionBy(one, two).orderBy(one))
    times = F.floor(F.col(n) / F.col(k)) + (first <= F.col(n) % F.col(k)).cast("long")
    out = joined.withColumn(n, times).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return out.select(*[f"`{c}`" for c in docs.columns])
