"""Token counts, periodic runs and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import WORD, corpus, table  # noqa: F401

ODD = "doc_id long, text string, n_tokens string, n_words string, runs string, n string, form string, c0 string"


def odd_table(spark, rows):
    """Rows (id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], ODD)


# Token counts


def vocabulary():
    import public_tokenizers as own

    return own.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


def test_pretokens_and_pieces_add_up_to_the_library():
    from parchmint.llm.tokens import PLAIN, Splitter

    own, count = Splitter(vocabulary()), library()
    assert own.plain

    def mine(text):
        found, n = own.units(text)
        return n + sum(own.pieces(p) for unit in found for p in own.pretokens(unit))

    for c in map(chr, PLAIN):
        for text in (c, f"a{c}b", f"1{c}{c}'s", f" {c}-{c}", f"'{c}"):
            assert mine(text) == count(text), repr(text)
    draw = random.Random(1)
    parts = [*map(chr, PLAIN), *"日本ΏΣⅨ² \n", "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "'s", "'LL", "\x1c", " ", "é"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert mine(text) == count(text), repr(text)


@pytest.mark.parametrize("most", [1 << 17, 20, 0])
def test_counts_equal_the_library(spark, corpus, most):  # noqa: F811
    from parchmint.llm.tokens import count_tokens

    texts = ["It's 12 o'clock <|endoftext|>now", "日本語 text", "x" * 5000, " ".join(f"w{i}" for i in range(30000)), "café CAFÉ", "y z\n" * 3000]
    rows = [(i, t) for i, t, _ in corpus] + [(100 + i, t) for i, t in enumerate(texts)] + [(None, "lonely words"), (None, "lonely words"), (3, None)]
    got = count_tokens(odd_table(spark, rows).repartition(4), vocabulary(), limit=100, most=most).collect()
    count = library()
    want = Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    assert count_tokens(odd_table(spark, []), vocabulary()).count() == 0


def test_frequent_keeps_both_bounds(spark):
    from parchmint.llm.tokens import frequent

    vocab = spark.createDataFrame([(f"p{i:03}", 1000 // (i + 1)) for i in range(200)], "piece string, n long")
    for most, size in ((50, 10**6), (10**6, 120), (0, 10), (10**6, 10**6)):
        cut = frequent(vocab, most, size)
        n = 0 if cut is None else sum(1000 // (i + 1) >= cut for i in range(200))
        assert n <= most and n * 4 <= size
    assert frequent(vocab, 10**6, 10**6) == 5


def test_other_tokenizers_are_refused(tmp_path):
    import json

    from parchmint.llm.tokens import Splitter

    told = json.load(open(vocabulary(), encoding="utf-8"))
    told["added_tokens"][0]["lstrip"] = True
    (tmp_path / "odd.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        Splitter(str(tmp_path / "odd.json"))


# Periodic runs


def brute_runs(t, least=6, times=4):
    n, out = len(t), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and all(any(t[x] != t[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn_words(draw):
    n, k = draw.randint(0, 60), draw.choice([1, 2, 3, 30])
    t = [b"%d" % draw.randint(0, k) for _ in range(n)]
    if n and draw.random() < 0.5:
        a, p = draw.randint(0, n - 1), draw.randint(1, max(1, n // 4))
        t = [t[i if i < a else a + (i - a) % p] for i in range(n)]
    return t


def test_runs_equal_brute_force():
    from parchmint.llm.periods import runs_of_texts

    draw = random.Random(3)
    for _ in range(150):
        texts = [drawn_words(draw) for _ in range(draw.randint(1, 12))]
        for least, times in ((6, 4), (5, 3), (3, 2)):
            for t, got in zip(texts, runs_of_texts(texts, least, times)):
                assert list(map(tuple, got.tolist())) == brute_runs(t, least, times)
    with pytest.raises(ValueError):
        runs_of_texts([[b"a"] * 9], 2, 2)


def test_runs_of_long_texts_with_few_levels_and_parts(monkeypatch):
    from parchmint.llm import periods

    texts = [[b"a"] * 5000, [b"%d" % (i % 700) for i in range(5000)], [b"x", *[b"%d" % (i % 300) for i in range(5000)]], [b"%d" % i for i in range(5000)]]
    want = [[[0, 5000, 1]], [[0, 5000, 700]], [[1, 5000, 300]], []]
    assert [r.tolist() for r in periods.runs_of_texts(texts)] == want
    monkeypatch.setattr(periods, "NAME_BYTES", 1)
    monkeypatch.setattr(periods, "PAIRS", 100)
    assert [r.tolist() for r in periods.runs_of_texts(texts)] == want


def test_collapse_keeps_rows_and_clashing_columns(spark):
    from parchmint.llm.periods import collapse_runs, strongest

    rows = [(1, "spam ham " * 4 + "eggs"), (2, None), (None, ""), (2, "a " * 6), (2, "a " * 6), (5, "b " * 5), (6, "z " * 100_000 + "end"), (7, " \n ")]
    docs = odd_table(spark, rows)
    got = collapse_runs(docs.repartition(3))
    assert got.columns == [*docs.columns, "_n_words", "_runs", "collapsed"]
    told = Counter((r["doc_id"], r["_n_words"], tuple(map(tuple, r["_runs"])), r["collapsed"], r["runs"]) for r in got.collect())
    want = [(1, 9, ((0, 8, 2),), "spam ham eggs", "c"), (2, 0, (), "", "c"), (None, 0, (), "", "c"), (5, 5, (), "b b b b b", "c"), (6, 100_001, ((0, 100_000, 1),), "z end", "c"), (7, 0, (), "", "c")]
    assert told == Counter([*want, *[(2, 6, ((0, 6, 1),), "a", "c")] * 2])
    assert collapse_runs(odd_table(spark, [])).count() == 0
    ties = spark.createDataFrame([([(9, 8, 2), (3, 8, 2), (1, 11, 3)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in ties.select(strongest(ties["runs"])).collect()] == [(9, 8, 2), None]


def test_query_of_runs_against_brute_force(spark, corpus, tmp_path):  # noqa: F811
    from parchmint.llm.queries import op12_periodic_runs

    rows = [(i, t) for i, t, _ in corpus] + [(1000 + i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(i * 9))) for i in range(40)] + [(None, "one two three four")]
    odd_table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for doc, text in rows:
        ws, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode()) if doc is not None else 1
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(ws)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(doc, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))] += 1
    assert Counter(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect())) == want
    assert sum(x[1] > 0 for x in want) > 3


# Fill-in-the-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_functions_compose_to_the_scan_of_the_whole():
    from parchmint.llm.fim import START, composed, transition, unit_starts

    draw = np.random.default_rng(5)
    for _ in range(200):
        data = draw.choice(np.frombuffer(b"ab \n", np.uint8), draw.integers(0, 60))
        cuts = np.sort(draw.integers(0, len(data) + 1, draw.integers(0, 9)))
        parts = [transition(p) for p in np.split(data, cuts)]
        ends, counts = composed(*(np.array([p[i] for p in parts]) for i in (0, 1)))
        for k, stop in enumerate([*cuts.tolist(), len(data)]):
            assert counts[k, START] == len(unit_starts(data[:stop], START)) == len(UNIT.findall(data[:stop].tobytes().decode()))
            for entry in range(3):
                assert counts[k, entry] == len(unit_starts(data[:stop], entry))


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_parts_against_brute_force(spark, corpus, chunk):  # noqa: F811
    from parchmint.llm.fim import fill_in_middle, restored

    texts = [" lead", "trail ", "éè 日本  x", "<P> marked", "a<S", "<", "\t\n ", "<|P|> fine <", "word " * 40_000, "x" * 70_000, "\U0001f600 " * 30]
    rows = [(i, t) for i, t, _ in corpus] + [(500 + i, t) for i, t in enumerate(texts * 4)] + [(None, "no id at all"), (None, "no id at all")]
    docs = odd_table(spark, rows)
    out = fill_in_middle(docs.repartition(5), chunk=chunk)
    assert out.columns == [*docs.columns, "_n", "_form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "text", "_n", "_form", "prefix_chars", "middle_chars", "output", restored(out["output"], out["_form"]).alias("back"), "c0").collect()
    want = Counter()
    for doc, text in rows:
        units = UNIT.findall(text or "")
        n, hex_ = len(units), hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
        h = [int(hex_[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            told = ("plain", None, None, text or "")
        elif h[3] % 100 < 80:
            told = ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            told = ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        want[(doc, text, n, *told, text or "", "f")] += 1
    assert Counter(map(tuple, got)) == want
    assert {k[3] for k in want} == {"plain", "psm", "spm"}
    assert fill_in_middle(odd_table(spark, [])).count() == 0
