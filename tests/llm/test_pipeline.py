"""The pipeline's stages against brute force over the smallest tables."""

from collections import Counter, defaultdict

import numpy as np
import xxhash

from tests.llm.test_operators import WORD, components

SF = "/root/testdata/sf0.001"
_DRAW = np.random.default_rng(42)
TABLES = [sum(1 << int(i) for i in _DRAW.choice(256, 20, replace=False)) for _ in range(64)]


def brute_wide(text):
    """Four SimHashes of the set of 5-word shingles, bit by bit."""
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    hashes, out, m = {xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles}, 0, (1 << 64) - 1
    for k in range(4):
        mixed = []
        for h in hashes:
            x = h * (2 * k + 1) * 0x9E3779B97F4A7C15 & m
            x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & m
            mixed.append(x ^ (x >> 32))
        for bit in range(64):
            if sum(x >> bit & 1 for x in mixed) * 2 > len(mixed):
                out |= 1 << (64 * k + bit)
    return out


def near(a, b):
    return (a ^ b).bit_count() <= 46 and any((a ^ b) & t == 0 for t in TABLES)


def test_each_stage(spark, tmp_path):
    import corpus_pipeline as own

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in own.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if name != own.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    rows = [[r.asDict() for r in x.collect()] for x in seen]
    letters = [r for r in rows[0] if any(map(str.isalpha, r["text"] or ""))]
    assert Counter(r["doc_id"] for r in rows[1]) == Counter(r["doc_id"] for r in letters)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    count = Counter(k for r in rows[1] for k in {key(x) for x in r["text"].split("\n")} - {""})
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if count[key(x)] < 10) for r in rows[1]}
    assert {r["doc_id"]: r["text"] for r in rows[2]} == want and all(r["n_chars"] == len(r["text"]) for r in rows[2])
    fps = {r["doc_id"]: brute_wide(r["text"]) for r in rows[2]}
    low = components(sorted(fps), lambda a, b: near(fps[a], fps[b]))
    assert {r["doc_id"] for r in rows[3]} == {i for i in fps if low[i] == i}
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in rows[3]}
    taken, largest, total = defaultdict(int), defaultdict(int), defaultdict(int)
    for s, n in size.values():
        total[s] += n
        largest[s] = max(largest[s], n)
    for r in rows[4]:
        taken[r["source"]] += size[r["doc_id"]][1]
    from parchmint.llm.mixing import fill_targets

    names = sorted(total)
    goal = fill_targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()), 2)
    assert all(abs(taken[s] - g) <= largest[s] for s, g in zip(names, goal))
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 2
    assert Counter(r["doc_id"] for r in rows[5] if r["start"] == 0) == Counter(r["doc_id"] for r in rows[4])


def test_near_copies_keeps_one_row_of_each_group_whatever_the_ids(spark):
    import corpus_pipeline as own
    from tests.llm.test_operators import words

    t = [" ".join(words(60, 900 + k)) for k in range(16)]
    rows = [(5, t[0]), (5, t[1]), (3, t[2]), (5, t[2]), (7, t[2]), (8, t[3]), (8, t[3]), (None, t[4]), (None, t[0]), *[(None, x) for x in t[5:15]], (9, None), (None, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    fps = {x: brute_wide(x) for _, x in rows}
    low = components(sorted(set(fps.values())), near)
    groups = defaultdict(list)
    for i, x in rows:
        groups[low[fps[x]]].append(i)
    got = own.near_copies(spark, docs, SF).collect()
    assert len(groups) == 16 and {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    want = Counter((g, min([i for i in ids if i is not None], default=None)) for g, ids in groups.items())
    assert Counter((low[fps[r["text"]]], r["doc_id"]) for r in got) == want


def test_rows_that_share_an_id_pass_every_stage(spark, tmp_path):
    import corpus_pipeline as own
    from tests.llm.test_operators import words

    text = lambda k, n=60: " ".join(words(n, 700 + k))
    rows = [(5, text(0), "en", "a"), (5, text(1, 90), "de", "a"), (None, text(2), "en", "b"), (None, text(3), "en", None), (7, None, "en", "a"), (8, "", "de", "b"), (9, text(4), None, "b"), (9, text(4), None, "b"), (10, " 123 ", "en", "a"), (11, text(5, 20_000), "en", "c")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _uses string").repartition(4)
    plain = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    written = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    first = own.language(spark, docs, SF)
    assert first.columns == own.COLUMNS and plain(first) == Counter((i, t, s) for i, t, _, s in written)
    second = own.lines(spark, docs, SF)
    assert plain(second) == Counter((i, t or "", s) for i, t, _, s in rows)
    third = own.near_copies(spark, docs, SF)
    assert Counter(r["doc_id"] for r in third.collect())[9] == 1
    fourth = plain(own.mixture(spark, docs, SF))
    size = {(i, t, s): len(WORD.findall(t or "")) for i, t, _, s in rows}
    most = Counter((i, t, s) for i, t, _, s in rows)
    assert set(fourth) <= set(most) and all(0 < n <= 2 * most[r] and size[r] for r, n in fourth.items())
    from parchmint.llm.mixing import fill_targets

    names = ["a", "b", "c", None]
    total = [sum(size[i, t, s] for i, t, _, s in rows if s == name) for name in names]
    goal = fill_targets(total, [5, 2, 1, 5], 1.5 * sum(total), 2)
    largest = {name: max(size[i, t, s] for i, t, _, s in rows if s == name) for name in names}
    for name, g in zip(names, goal):
        assert abs(sum(n * size[r] for r, n in fourth.items() if r[2] == name) - g) <= largest[name]
    fifth = own.sequences(spark, docs, SF).where("start = 0")
    assert Counter(r["doc_id"] for r in fifth.collect()) == Counter(i for i, *_ in rows)
    for _, stage in own.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_two_unlike_rows_of_one_id_are_not_multiplied(spark):
    from parchmint.llm.mixing import mixed_rows
    from tests.llm.test_operators import words

    rows = [(5, " ".join(words(10, 1)), "a"), (5, " ".join(words(30, 2)), "a"), (None, "x y", "a"), (None, "z", "a"), (6, "same", "a"), (6, "same", "a"), (6, "same", "a")]
    got = Counter(map(tuple, mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_uses=2).collect()))
    words_taken = sum(n * len(t.split()) for (_, t, _), n in got.items())
    assert abs(words_taken - 1.5 * 46) <= 30 and all(n <= 2 * rows.count(r) for r, n in got.items())


def test_wide_links_in_hot_buckets_and_recall(spark):
    from parchmint.llm.simhash import distance_for, near_representatives, wide_links

    draw = np.random.default_rng(3)
    assert distance_for(0.8) == 46
    base = [int(x) for x in draw.integers(0, 2**63, 40)]
    wide = [sum(base[4 * g + k] << (64 * k) for k in range(4)) for g in range(10)]
    values = {0, *wide}
    for w in wide:
        for _ in range(30):
            v = w
            for bit in draw.choice(256, int(draw.integers(1, 30)), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    fps = spark.createDataFrame([(v.to_bytes(32, "little"),) for v in values], "fp binary").repartition(5)
    for chunk in (1024, 5):
        links = [(int.from_bytes(r["a"], "little"), int.from_bytes(r["b"], "little")) for r in wide_links(fps, 46, chunk=chunk).collect()]
        assert all((a ^ b).bit_count() <= 46 for a, b in links)
        parent = {v: v for v in values}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in links:
            parent[root(a)] = root(b)
        want = components(sorted(values), near)
        groups, found = defaultdict(set), defaultdict(set)
        for v in values:
            groups[want[v]].add(v)
            found[root(v)].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))

    rows, pairs = [], 0
    for i in range(120):
        words = [f"w{x}" for x in draw.integers(0, 5000, 200)]
        other = words.copy()
        for at in draw.integers(0, 200, 1 + i % 5):
            other[at] = "new"
        a, b = ({tuple(w[j : j + 5]) for j in range(196)} for w in (words, other))
        if len(a & b) / len(a | b) >= 0.8:
            pairs += 1
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert pairs > 60 and len(got) <= len(rows) - 0.9 * pairs and {2 * (r["doc_id"] // 2) for r in got} == {r["doc_id"] for r in got if r["doc_id"] % 2 == 0}
