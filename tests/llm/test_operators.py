"""Each operator against a brute-force version on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, _size string, n_lines string, score string"


def table(spark, rows):
    """Documents (id, text, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "a", "b", "c") for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    draw = np.random.default_rng(seed)
    return [f"w{x}" for x in draw.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def corpus():
    base = words(300, 1)
    edit = base.copy()
    edit[150] = "changed"
    rows = [(1, " ".join(base), "b"), (2, " ".join(base), "a"), (3, " ".join(edit), None), (4, None, "a"), (5, "", "b"), (6, " \n ", "a"), (7, "one two", "b")]
    rows += [(10 + i, "\n".join([" ".join(words(30, 100 + i)), "  Same LINE\t", " ".join(words(20, 200 + i)), ""]), "ab"[i % 2]) for i in range(12)]
    rows += [(40 + i, " ".join(words(40, 300 + i) + base[20:90] + words(30, 400 + i)), "c") for i in range(4)]
    return rows + [(7, "one two", "b")]


# Mixing


def test_targets_stop_at_the_cap_and_excess_is_shared():
    from parchmint.llm.mixing import fill_targets

    got = fill_targets([100, 100, 100, 10], [5, 2, 1, 5], 310 * 1.5, 2)
    assert got[0] == 200 and got[3] == 20 and sum(got) == pytest.approx(465)
    assert all(g <= 2 * s + 1e-9 for g, s in zip(got, [100, 100, 100, 10]))
    assert fill_targets([], [], 0, 2) == []


def test_route_is_a_flow_of_least_cost():
    from itertools import product

    from parchmint.llm.mixing import route

    caps, own, quota = [3, 2, 2], [[0], [0, 1], [1]], [4, 5]
    flows = route(caps, own, quota, 2)
    total = sum(sum(p.values()) for level in flows for p in level)
    best = max((sum(a) for a in product(range(7), range(5), range(5), range(5)) if a[0] <= 6 and a[1] + a[2] <= 4 and a[3] <= 4 and a[0] + a[1] <= 4 and a[2] + a[3] <= 5), default=0)
    assert total == best == 9
    assert sum(sum(p.values()) for p in flows[0]) == 7  # every first use comes before a second
    for level in flows:
        assert all(sum(p.values()) <= c for p, c in zip(level, caps))


def test_many_patterns_are_routed_in_time():
    import time

    from parchmint.llm.mixing import route

    start, n = time.monotonic(), 20_000
    flows = route([10] * n, [[i] for i in range(n)], [15] * n, 2)
    assert all(sum(level[i][i] for level in flows) == 15 for i in range(n)) and time.monotonic() - start < 20


def test_join_one_gives_hot_and_other_keys(spark):
    from parchmint.llm.common import join_one

    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 500 + [f"k{i % 70}" for i in range(300)])], "k string, i long")
    one = rows.groupBy("k").count()
    for share in (1, 10, 1000):
        got = join_one(rows, one, ["k"], "count", 800, share).collect()
        assert len(got) == 800 and {(r["k"], r["count"]) for r in got} == set(map(tuple, one.collect()))


def test_mix_comes_near_targets_and_reruns_agree(spark, corpus):
    from pyspark.sql import functions as F

    from parchmint.llm.mixing import mix, mix_by_source

    docs = table(spark, corpus)
    rows = mix_by_source(docs).collect()
    assert len(rows) == len(corpus) and sorted(map(str, rows)) == sorted(map(str, mix_by_source(docs.repartition(5)).collect()))
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        (own,) = r["_targets"]
        assert r["_uses"] <= 2 and r["_taken"] == r["_uses"] * r["_size"]
        taken[own["source"]] += r["_taken"]
        target[own["source"]] = own["target"]
        largest[own["source"]] = max(largest[own["source"]], r["_size"])
    sizes = defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    assert set(target) == set(sizes)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    over = docs.select("*", F.when(F.col("doc_id") < 10, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"))).alias("m"), F.length("text").alias("k"))
    got = mix(over, F.col("m"), F.col("k"), seed=3)
    assert got.count() == len(corpus) and got.select("_size").dtypes[0][1] == "string"
    assert mix_by_source(docs.limit(0)).count() == 0


# Packing


def coder():
    import public_tokenizers as own

    return own.path("byte_bpe_50k.json"), own.path("byte_bpe_50k.tiktoken"), own.PATTERN


def test_cached_ids_equal_the_tokenizers():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from parchmint.llm.packing import Coder, added_tokens

    whole = Tokenizer.from_file(coder()[0])
    own = Coder(*coder(), added_tokens(coder()[0]))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(["ab", "'s", " ", "  ", "\n", ".", "B9", "é", "日", "\t", "***", " ", "Foo", "\u0085", "<|endoftext|>", " x"]), max_size=25).map("".join) | st.text(max_size=40))
    def check(text):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

    check()


def test_shortest_pack_first_places_every_length():
    from parchmint.llm.packing import shortest_pack_first

    draw = np.random.default_rng(0)
    for width in (1, 2, 7, 64):
        histogram = {i: int(n) for i, n in enumerate(draw.integers(0, 50, width), 1) if n}
        got = Counter()
        for count, pattern in shortest_pack_first(histogram, width):
            assert count > 0 and sum(pattern) <= width
            got.update({k: count * n for k, n in Counter(pattern).items()})
        assert got == histogram
    assert shortest_pack_first({}, 8) == []


@pytest.mark.parametrize("histogram", [{100: 10}, {1: 200}, {300: 5000, 250: 4000, 200: 3000}, {1: 400_000, 2: 300_000, 3: 300_000}, {512: 9, 5: 3}, {700: 50, 200: 100, 100: 20}])
def test_few_lengths_are_packed_with_little_padding(histogram):
    from parchmint.llm.packing import shortest_pack_first

    got, n = Counter(), 0
    for count, pattern in shortest_pack_first(histogram, 1024):
        assert sum(pattern) <= 1024
        got.update({k: count * x for k, x in Counter(pattern).items()})
        n += count
    assert got == histogram
    least = max(-(-sum(k * x for k, x in histogram.items()) // 1024), sum(x for k, x in histogram.items() if k > 512))
    assert n <= 1.1 * least


def test_empty_documents_share_a_sequence_and_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    from parchmint.llm.packing import pack

    odd = "hello <|endoftext|> world <|endoftext|>\n x"
    rows = pack(table(spark, [*[(i, "", "a") for i in range(200)], (200, odd, "a")]), *coder()).collect()
    assert {r["sequence_id"] for r in rows} == {0} and sorted(r["offset"] for r in rows if r["doc_id"] < 200)[-1] >= 199
    ids = np.array([*Tokenizer.from_file(coder()[0]).encode(odd, add_special_tokens=False).ids, 0], "<u4")
    assert 50256 in ids and {(r["doc_tokens"], r["ids_crc32"]) for r in rows if r["doc_id"] == 200} == {(len(ids), zlib.crc32(ids.tobytes()))}


def test_packing_is_an_exact_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    from parchmint.llm.packing import pack

    whole = Tokenizer.from_file(coder()[0])
    docs = table(spark, [*corpus, (90, " ".join(words(4000, 9)), "z")])
    rows = pack(docs, *coder()).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert sorted(places) == list(range(len(places)))
    for i, text, _ in docs.select("doc_id", "text", "source").collect():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]})
        assert own == [(a, min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes())) for a in range(0, len(ids), 1024)]
        assert {r["doc_tokens"] for r in pieces[i]} == {len(ids)}
    assert pack(docs.limit(0), *coder()).count() == 0


# Sharding


def test_key_law_and_slots(spark):
    from parchmint.llm.sharding import even_tree, shard

    rows = [(i, f"text {i % 7}", "s") for i in range(4000)] + [(None, None, None), (5, "", None), (5, "", None)]
    got = shard(table(spark, rows), even_tree(16), even_tree(17)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["_shard"]].append(r["_slot"])
        assert r["_grown"] in (r["_shard"], 16)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * min(map(len, by.values()))
    moved = sum(r["_grown"] == 16 for r in got)
    assert 0.5 / 17 < moved / len(got) < 2 / 17
    five = {r["_shard"] for r in got if r["doc_id"] == 5}
    assert len(five) == 1
    assert {r["_crc"] for r in got if r["doc_id"] == 8} == {zlib.crc32(b"text 1")}
    assert got[0].asDict()["_size"] == "a" and {r["__size"] for r in got if r["doc_id"] is None} == {1}
    assert shard(table(spark, rows).limit(0), even_tree(4)).count() == 0


def drawn(key, leaves):
    """The shard of a key by plain XXH64, level by level."""
    import math
    import struct

    def clock(leaf):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        for x in (0, leaf.region, leaf.rack, leaf.shard):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return -math.log(((h >> 12) * 2 + 1) / 2**53) / leaf.weight

    own = leaves
    for level in ("region", "rack", "shard"):
        least = defaultdict(lambda: math.inf)
        for x in own:
            least[getattr(x, level)] = min(least[getattr(x, level)], clock(x))
        name = min(least, key=least.get)
        own = [x for x in own if getattr(x, level) == name]
    return own[0].shard


def test_draws_equal_an_independent_version(spark):
    from pyspark.sql import functions as F

    from parchmint.llm.sharding import Leaf, even_tree, place

    uneven = [Leaf(x.shard, x.region, x.rack, 1.0 + x.shard % 3) for x in even_tree(11)]
    keys = [*range(-50, 400), 1 << 40, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", place(F.col("k"), even_tree(16)).alias("a"), place(F.col("k"), uneven).alias("b"), place(F.col("k"), even_tree(1)).alias("c")).collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(drawn(r["k"], even_tree(16)), drawn(r["k"], uneven), 0) for r in rows]


def test_a_thousand_shards(spark):
    from pyspark.sql import functions as F

    from parchmint.llm.sharding import even_tree, place

    tree = even_tree(1000)
    rows = spark.range(300).select("id", place(F.col("id"), tree).alias("a"), place(F.col("id"), even_tree(1001)).alias("b")).collect()
    assert [r["a"] for r in rows[:60]] == [drawn(r["id"], tree) for r in rows[:60]]
    assert {r["b"] for r in rows if r["a"] != r["b"]} <= {1000} and len({r["a"] for r in rows}) > 200


def test_one_more_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    from parchmint.llm.sharding import even_tree, place

    rows = spark.range(4000).select(*[place(F.col("id"), even_tree(n)).alias(f"n{n}") for n in range(1, 42)]).collect()
    for n in range(1, 41):
        moved = [r[f"n{n + 1}"] for r in rows if r[f"n{n}"] != r[f"n{n + 1}"]]
        assert set(moved) == {n} and 0.5 / (n + 1) < len(moved) / len(rows) < 1.7 / (n + 1)


def test_a_weight_moves_rows_into_its_leaf_alone(spark):
    from pyspark.sql import functions as F

    from parchmint.llm.sharding import Leaf, even_tree, place

    before = even_tree(16)
    after = [Leaf(x.shard, x.region, x.rack, 2.0 if x.shard == 3 else 1.0) for x in before]
    rows = spark.range(3000).select(place(F.col("id"), before).alias("a"), place(F.col("id"), after).alias("b")).collect()
    assert {r["b"] for r in rows if r["a"] != r["b"]} == {3}


# Line deduplication


@pytest.mark.parametrize("few", [100_000, 0])
def test_lines(spark, corpus, few):
    from parchmint.llm.lines import dedup_lines

    corpus = [*corpus, (None, "same line\nown", "a"), (None, None, "b"), (95, "x y\n" * 30_000 + "same line", "a")]
    docs = table(spark, corpus)
    got = dedup_lines(docs, min_docs=10, few=few).collect()
    keys = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    count = Counter(k for _, t, _ in corpus for k in {keys(x) for x in (t or "").split("\n")} - {""})
    want = Counter()
    for i, t, s in corpus:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if count[keys(x)] < 10 or not keys(x)]
        want[i, "\n".join(kept), s, len(all_), len(all_) - len(kept)] += 1
    assert Counter((r["doc_id"], r["text"], r["source"], r["_n_lines"], r["n_dropped"]) for r in got) == want
    assert any(r["n_dropped"] for r in got) and got[0]["n_lines"] == "b"
    assert dedup_lines(docs.limit(0), few=few).count() == 0


# SimHash


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    low = {n: n for n in nodes}
    while True:
        new = {n: min([low[n], *[low[m] for m in nodes if linked(n, m)]]) for n in nodes}
        if new == low:
            return low
        low = new


def test_simhash(spark, corpus):
    from parchmint.llm.simhash import simhash_components

    got = simhash_components(table(spark, corpus)).collect()
    fps = [(i, brute_fingerprint(t)) for i, t, _ in corpus]
    assert Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == Counter(fps)
    own = dict(fps)
    low = components(sorted(own), lambda a, b: (own[a] ^ own[b]).bit_count() <= 3)
    assert {r["doc_id"]: r["component_id"] for r in got} == low
    assert low[2] == 1 and low[5] == 4 == low[6]
    assert simhash_components(table(spark, corpus).limit(0)).count() == 0


def test_links_of_hot_buckets_connect_all_that_is_close(spark):
    from parchmint.llm.graph import components as connected
    from parchmint.llm.simhash import fingerprint_links

    draw = np.random.default_rng(2)
    centre = int(draw.integers(0, 1 << 62))
    values = {centre ^ sum(1 << int(b) for b in draw.choice(64, k, False)) for k in (1, 2, 3, 5, 9) for _ in range(40)}
    values |= {int(x) for x in draw.integers(0, 1 << 62, 100)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = dict(map(tuple, connected(fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk=16)).collect()))
    low = components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {v: roots.get(v, v) for v in signed} == low


def test_components_of_paths_stars_and_nothing(spark):
    from parchmint.llm.graph import components as connected

    edges = [(i, i + 1) for i in range(30)] + [(1000, x) for x in range(100, 130)] + [(5, 5), (7, None)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {x: 100 for x in [*range(100, 130), 1000]}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# Exact deduplication


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, corpus, tmp_path, weak):
    from pyspark.sql import functions as F

    from parchmint.llm.exact import dedup_exact, sha256

    rows = [*corpus, (None, "one two", None), (8, "ONE two", None)]
    path = str(tmp_path / "documents.parquet")
    table(spark, rows).repartition(3).write.parquet(path)
    digest = (lambda t: F.octet_length(t).cast("string").cast("binary")) if weak else sha256  # weak: other texts share it
    got = dedup_exact(spark, path, digest=digest).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        own = [r for r in got if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        assert sorted(str(r["id"]) for r in own) == sorted(map(str, ids))
        assert {r["keep_id"] for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert {r["group_size"] for r in own} == {len(ids)} and sum(r["kept"] for r in own) == 1


def test_exact_goes_on_where_it_stopped(spark, tmp_path):
    from parchmint.llm.exact import dedup_exact

    path, state, log = str(tmp_path / "documents.parquet"), str(tmp_path / "state"), str(tmp_path / "log")
    table(spark, [(1, "a", "x"), (2, "b", "x")]).coalesce(1).write.parquet(path)
    assert {r["keep_id"] for r in dedup_exact(spark, path, state=state, log=log).collect()} == {1, 2}
    table(spark, [(3, "a", "x")]).coalesce(1).write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in dedup_exact(spark, path, state=state, log=log).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True)}


def test_exact_of_an_empty_table(spark, tmp_path):
    from parchmint.llm.exact import dedup_exact

    path = str(tmp_path / "documents.parquet")
    table(spark, []).write.parquet(path)
    assert dedup_exact(spark, path).count() == 0


# Substring deduplication


def brute_windows(rows, width):
    split = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(i, first.get(k, i))
    out = Counter()
    for i, w in split:
        gone = {x for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < i for x in range(s, s + width)}
        out[i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)] += 1
    return out


@pytest.mark.parametrize("batches", [1, 6])
def test_windows(spark, corpus, batches):
    from parchmint.llm.windows import dedup_windows

    base = words(300, 1)
    rows = [*corpus, (60, " ".join(["x"] * 200), "r"), (61, " ".join(["x"] * 120), "r"), (62, " ".join(base[100:150]), "s"), (63, " ".join(base[100:149]), "s"), (64, " ".join(base[90:149] + ["q"] + base[100:160]), "s"), (65, " ".join(words(60, 77)), "s"), (65, " ".join(words(5, 78) + base[100:155] + words(9, 79)), "s"), (66, " ".join(words(60, 77)[:55]), "s"), (67, " ".join(words(30_000, 80, 5000) + base[10:70]), "s")]
    got = dedup_windows(table(spark, rows), batches=batches, fan=1 if batches > 1 else 2).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_windows(rows, 50)
    assert got[0]["n_lines"] == "b"


def test_an_index_takes_batches_in_two_sessions(spark, tmp_path):
    from parchmint.llm.windows import WindowIndex, dedup_windows

    draw = np.random.default_rng(11)
    pieces = [words(int(n), 70 + k, 40) for k, n in enumerate(draw.integers(5, 80, 12))]
    rows = [(i, " ".join(x for k in draw.integers(0, 12, 4) for x in pieces[k]), "s") for i in range(60)]
    rows += [(20, rows[3][1] + " more", "t"), (45, rows[44][1], "t"), (59, rows[0][1], None)]
    got, seen = [], []
    for session, (a, b) in zip((spark, spark, spark.newSession()), ((0, 20), (20, 45), (45, 60))):
        index = WindowIndex(session, str(tmp_path / "index"), width=20, fan=1)
        part = dedup_windows(table(session, [r for r in rows if a <= r[0] < b]), index=index)
        got += part.collect()
        seen.append(sorted(level for _, level, _ in index.runs))
        for run, *_ in index.runs:  # a run has each block once, also after compaction
            held = [(r["hash"], bytes(r["digest"])) for r in session.table(run).collect()]
            assert len(held) == len(set(held))
        index.close()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_windows(rows, 20)
    assert seen == [[0], [1], [0, 1]]


def test_windows_of_the_largest_and_smallest_ids(spark):
    from parchmint.llm.windows import dedup_windows

    text = " ".join(words(80, 90))
    rows = [(2**63 - 1, text, "s"), (-(2**63), text, "s"), (5, "x " + text, "s"), (2**63 - 2, " ".join(words(60, 91)), "s"), (None, text, "s")]
    got = dedup_windows(table(spark, rows)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {2**63 - 1: 80, -(2**63): 0, 5: 80, 2**63 - 2: 0, None: 0}


@pytest.mark.parametrize("batches", [1, 3])
def test_one_passage_in_unlike_surroundings(spark, batches, monkeypatch):
    from parchmint.llm import windows

    shared = words(45, 92)
    rows = [(i, " ".join([*words(20, 1000 + i), *shared, *words(20 + i % 3, 2000 + i)]), "s") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "s") for i in range(0, 60, 7)] + [(200, " ".join(words(400, 93)), "s")]
    seen = []
    close = windows.WindowIndex.close
    monkeypatch.setattr(windows.WindowIndex, "close", lambda self: (seen.append([hot for *_, hot in self.runs]), close(self))[1])
    got = windows.dedup_windows(table(spark, rows), batches=batches).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_windows(rows, 50)
    assert any(seen[0])  # runs of enough documents spread the hashes of the passage


def test_windows_random(spark):
    from parchmint.llm.windows import dedup_windows

    draw = np.random.default_rng(5)
    pieces = [words(int(n), 50 + k, 30) for k, n in enumerate(draw.integers(5, 80, 12))]
    rows = [(i, " ".join(x for k in draw.integers(0, 12, 4) for x in pieces[k]), "s") for i in range(40)]
    got = dedup_windows(table(spark, rows), width=20).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_windows(rows, 20)
    assert dedup_windows(table(spark, rows).limit(0)).count() == 0


# Vectors


def test_vectors_against_brute_force(spark):
    from parchmint.llm.vectors import link_vectors

    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 16))
    rows = [(i, (c + draw.normal(size=16) * 0.03 * (k % 3)).tolist(), k % 2) for i, (k, c) in enumerate((k, c) for c in centres for k in range(12))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, rows[0][1], None), (n + 5, [1.0], 0), (n + 6, [], 1), (3, rows[3][1], 1)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    ok = [(i, np.array(v), l) for i, v, l in rows if i < n]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in ok])
    cos = (unit @ unit.T >= 0.98) & (np.array([x[2] for x in ok])[:, None] == np.array([x[2] for x in ok])[None])
    for margin in (None, np.sqrt(0.04)):
        got = link_vectors(vectors, margin=margin, lists=12).collect()
        assert len(got) == len(rows)
        links = sum(r["n_links"] for r in got)
        want = cos.sum() - len(ok)
        assert links >= 0.9 * want if margin is None else links == want
    ids = [x[0] for x in ok]
    low = components(range(len(ok)), lambda a, b: cos[a, b])
    want = {}
    for k, i in enumerate(ids):
        want[i] = min(ids[low[k]], want.get(i, 1 << 60))
    for r in got:
        if r["vec_id"] < n:
            assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"])
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
    assert link_vectors(vectors.limit(0)).count() == 0


def test_vectors_of_every_length_link(spark):
    from parchmint.llm.vectors import link_vectors

    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=3).tolist(), "a") for i in range(40)]
    rows += [(50 + i, (np.array(rows[i][1]) * 2).tolist(), "a") for i in range(5)]
    rows += [(100, [1.0, 2.0], "a"), (101, [1.0, 2.0], "a"), (102, [2.0, 4.0], "a"), (103, [1.0, 2.0, 0.0], "a"), (104, [2.0, 4.0], "b"), (105, [7.0], "a"), (106, [-7.0], "a"), (107, [0.5], "a")]
    long = draw.normal(size=50)
    rows += [(110, long.tolist(), "a"), (111, (long * 3 + 1e-3).tolist(), "a"), (112, [*long[:25].tolist(), *(-long[25:]).tolist()], "a"), (None, [1.0, 2.0], "a"), (113, [1.0, 2.0], None)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, component_id string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(vectors).collect()}

    def linked(a, b):
        (i, x, p), (j, y, q) = a, b
        if i is None or j is None or p is None or p != q or len(x) != len(y):
            return False
        x, y = np.array(x), np.array(y)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    low = components(range(len(rows)), lambda i, j: linked(rows[i], rows[j]))
    assert got == {r[0]: (sum(linked(r, o) for k, o in enumerate(rows) if k != i), rows[low[i]][0]) for i, r in enumerate(rows)}
    assert got[100][0] == 2 and got[None] == (0, None)


def test_vectors_count_links_across_list_borders_at_both_ends(spark):
    from parchmint.llm.vectors import link_vectors

    turn = np.random.default_rng(3).uniform(0, 2 * np.pi, 600)
    unit = np.stack([np.cos(turn), np.sin(turn)], 1)
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(unit)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in link_vectors(vectors, lists=12).collect()}
    assert got == dict(enumerate(((unit @ unit.T >= 0.98).sum(1) - 1).tolist()))


# Models


def test_toxic_words_are_learned_and_located(spark):
    from parchmint.llm.toxicity import held_out, score_toxicity

    draw = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        w = [f"v{x}" for x in draw.integers(0, 300, 60)]
        toxic = i % 3 == 0
        if toxic:
            w[int(draw.integers(0, 60))] = "Badword" + "abcdef"[i % 6] + ","
        rows.append((i, " ".join(w[:30]) + "\n" + " ".join(w[30:]), "s"))
        labels.append((i, int(toxic)))
    rows += [(9001, None, "s"), (9002, "", "s")]
    docs, known = table(spark, rows), spark.createDataFrame([*labels, (9001, None), (0, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, known).collect()}
    text = {i: t for i, t, _ in rows}
    for i, y in labels:
        assert got[i]["predicted"] == y and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert [text[i][s["start"] : s["end"]][:7] for s in got[i]["spans"]] == ["Badword"] * y
    assert got[9001]["predicted"] == got[9002]["predicted"] == 0 and 0 <= got[9001]["score"] <= 1
    blank = score_toxicity(docs, known.limit(0)).select("predicted", "score").distinct().collect()
    assert {r["predicted"] for r in blank} == {0}
    assert score_toxicity(docs.limit(0), known).count() == 0
    assert docs.where(held_out("doc_id")).count() > 100


def test_field_marginals_equal_enumeration():
    from itertools import product

    from parchmint.llm.toxicity import Field

    model = Field({"badw": 3.0}, bias=-1.0, move=np.array([[0.0, -0.7], [0.4, 1.1]]))
    scores = np.array([0.0, 3.0, 0.0, 0.0, 2.0])
    weight = {y: np.exp(sum((scores[i] - 1.0) * y[i] for i in range(5)) + sum(model.move[y[i], y[i + 1]] for i in range(4))) for y in product((0, 1), repeat=5)}
    z = sum(weight.values())
    assert np.allclose(model.marginals(scores), [sum(w for y, w in weight.items() if y[i]) / z for i in range(5)])


def test_language_on_held_out_rows(spark):
    from parchmint.llm.language import identify

    draw = np.random.default_rng(4)
    parts = {"aa": ["lo", "ra", "ti", "no"], "bb": ["sch", "ung", "ßer", "der"], "cc": ["éau", "oix", "que", "les"]}
    rows = [(i, " ".join("".join(draw.choice(parts[k], 3)) for _ in range(20)), k) for i in range(300) for k in [list(parts)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, rows[0][1], None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert all(got[i]["lang_pred"] == k and 0.5 < got[i]["score"] <= 1 for i, _, k in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert {r["lang_pred"] for r in identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert identify(docs.limit(0)).count() == 0


def brute_grams(text):
    marked = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return {marked[i : i + n] for n in (1, 2, 3) for i in range(len(marked) - n + 1)}


def test_kernels_count_every_common_gram():
    from parchmint.llm.language import Kernel, gram_codes

    texts = ["Ab c!d", "abc", "İßx 語る", "", "12", "a" * 5000 + " b", "𐐀𐐨 z"]
    for x in texts:
        assert len(gram_codes(x)) == len(brute_grams(x))
    model = Kernel.of(list(map(gram_codes, texts)), [])
    for x in [*texts, "Ab zz", "new"]:
        got = model.kernels(gram_codes(x)) * model.scale
        for y, k in zip(texts, got.tolist()):
            a, b = brute_grams(x), brute_grams(y)
            assert k == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, rel=1e-9)


def test_ridge_on_landmarks_equals_kernel_ridge_when_all_are_landmarks():
    from parchmint.llm.language import Kernel, fit, gram_codes

    draw = np.random.default_rng(7)
    texts = ["".join(draw.choice(list("abcdef" if i % 2 else "cdefgh"), 12)) for i in range(40)]
    names = ["xy"[i % 2] for i in range(40)]
    got = fit(texts, names).scores(["abcabc", "ghghgh", "cdef"])
    all_ = [brute_grams(t) for t in texts]
    kernel = lambda a: np.array([[len(p & q) / (len(p) * len(q)) ** 0.5 for q in all_] for p in a])
    k = kernel(all_)
    y = np.array([[1.0 if m == x else -1.0 for x in "xy"] for m in names])
    want = kernel(map(brute_grams, ["abcabc", "ghghgh", "cdef"])) @ np.linalg.solve(k + 1e-2 * 40 / 100 * np.eye(40), y)
    assert np.allclose(got, want, atol=2e-3)


def test_scripts_that_were_hardly_seen_are_told_apart():
    from parchmint.llm.language import fit

    draw = np.random.default_rng(0)
    scripts = {k: [chr(first + i) for i in range(800)] for k, first in (("a", 0x4E00), ("b", 0x6000))}
    made = lambda n: [("".join(draw.choice(scripts[k], 15)), k) for _ in range(n) for k in "ab"]
    model, known = fit(*zip(*made(400))), made(300)
    said = model.scores([t for t, _ in known]).argmax(1)
    assert np.mean([model.names[i] == k for i, (_, k) in zip(said, known)]) > 0.95


def test_language_keeps_clashing_columns_and_very_long_texts(spark):
    from parchmint.llm.language import identify

    long = "lorem ipsum dolor " * 60_000
    rows = [(i, ("schaden und ungern " if i % 2 else "lorem ipsum dolor ") * 3, "de" if i % 2 else "la", "p", 0.5) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, long, None, "p", 0.5), (7, long, "la", "p", 0.5)], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify(docs, keep_text=True).collect()
    assert len(got) == 42 and {(r["lang_pred"], r["score"]) for r in got} == {("p", 0.5)}
    assert all(r["_lang_pred"] == ("de" if r["text"].startswith("sch") else "la") and 0 <= r["_score"] <= 1 for r in got)
    assert {r["held_out"] for r in identify(docs).collect() if r["doc_id"] is None} == {zlib.crc32(b"") % 4 == 2}


def test_many_languages_fit_in_bounded_memory(monkeypatch):
    import tracemalloc

    from parchmint.llm import language

    draw = np.random.default_rng(8)
    letters = [[chr(0x3400 + 200 * k + i) for i in range(200)] for k in range(125)]
    texts, names = [], []
    for k in range(125):
        for _ in range(12):
            texts.append("".join(draw.choice(letters[k], 1500)))
            names.append(f"l{k:03}")
    tracemalloc.start()
    model = language.fit(texts, names)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    probe = ["".join(draw.choice(letters[k], 300)) for k in range(0, 125, 7)]
    direct = model.scores(probe)
    assert [model.names[i] for i in direct.argmax(1)] == [f"l{k:03}" for k in range(0, 125, 7)]
    assert model.told is None  # too many n-grams by languages for a table
    few = language.fit(texts[:60], names[:60])
    assert few.told is not None
    with_table, few.told = few.scores(texts[:9]), None
    assert np.allclose(with_table, few.scores(texts[:9]), atol=1e-4)


def test_the_run_of_the_last_batch_holds_no_windows(spark):
    from parchmint.llm.windows import WindowIndex

    words = [f"w{i}" for i in range(90)]
    texts = [(1, " ".join(words)), (2, " ".join(["x", *words[:60], "y"])), (3, " ".join(["z", *words[20:]])), (4, " ".join(words[5:80] + ["q"] * 30))]
    docs = spark.createDataFrame(texts, "doc long, text string")
    spans = []
    for last in (False, True):
        index = WindowIndex(spark, width=20)
        first, second = index.add(docs.where("doc < 3")), index.add(docs.where("doc >= 3"), last=last)
        spans.append({(r["doc"], w) for part in (first, second) for r in part.collect() for w in range(r["start"], r["start"] + r["n"])})
        held = [spark.table(run).where("windows is not null").count() for run, *_ in index.runs]
        assert held[0] > 0 and (held[1] == 0) == last
        index.close()
    assert spans[0] == spans[1] and {d for d, _ in spans[0]} == {2, 3, 4}
