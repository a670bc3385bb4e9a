"""Collocations, periodic runs and exact search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import collocations, periodic, pivots, queries, recompression

from .test_text_operators import SMALL_TABLE, empty, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_collocations(rows, least, top, cover):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        seen = counts.setdefault(lang, Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                seen.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {}
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                found[p] = (a, f[p[:k]], f[p[k:]], s)
        long = [(p, a) for p, (a, *_) in found.items() if len(p) == 3]
        dropped = {q for p, a in long for q in (p[:2], p[1:]) if q in found and 100 * a >= cover * found[q][0]}
        order = sorted((p for p in found if p not in dropped), key=lambda p: (-found[p][3], -found[p][0], " ".join(p).encode()))
        for rank, p in enumerate(order[:top], 1):
            a, left, right, s = found[p]
            out.append((lang, rank, " ".join(p), a, left, right, total[lang], s))
    return sorted(out)


def mined(docs, **how):
    return sorted(tuple(r) for r in collocations.mine_collocations(docs, **how).collect())


@pytest.mark.parametrize("top, frontier", [(3, 2), (40, 2), (2000, 4)])
def test_collocations_equal_brute_force_however_narrow_the_frontier(spark, monkeypatch, top, frontier):
    monkeypatch.setattr(collocations, "FRONTIER", frontier)
    rng = random.Random(top)
    fixed = ["new york city", "of the", "rare couple", "a b c d", "tick tock tick tock"]
    rows = []
    for k in range(160):
        words = [rng.choice("the of a in on it x y z w é ß".split()) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " \x0b"]) for w in words)
        rows.append((rng.choice(["en", "de", None, ""]), text.upper() if k % 9 == 0 else text))
    rows += [("en", None), (None, ""), ("one", "alone"), ("en", rows[0][1]), ("en", rows[0][1]), ("long", "very long text, " * 20_000)]
    docs = spark.createDataFrame([(x, y, "clash", k) for k, (x, y) in enumerate(rows)], "lang string, text string, phrase string, n int")
    want = brute_collocations(rows, 3, top, 50)
    assert mined(docs, least=3, top=top) == want and want


def test_collocation_filters_only_save_work(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL_TABLE}/documents.parquet")
    want = brute_collocations([(r["lang"], r["text"]) for r in docs.collect()], 10, 2000, 50)
    assert mined(docs) == want
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)  # full at once: everything is counted
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 500)
    assert mined(docs) == want
    assert mined(odd_documents(spark).withColumn("lang", F.col("source")), least=3) == brute_collocations(
        [(r["source"], r["text"]) for r in odd_documents(spark).collect()], 3, 2000, 50)
    assert mined(empty(spark, "lang string, text string")) == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**15, 10**15 + 1, 10**15 + 7), (3, 7, 11), (999_999_999_999_999, 999_999_999_999_999, 10**15), (10, 10, 10)]
    found = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in found.collect())


def brute_runs(words, least=24, repeats=3):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic_texts(seed, count):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        n = int(rng.integers(0, 260))
        w = rng.integers(0, int(rng.integers(1, 6)), n)
        for _ in range(rng.integers(0, 4)):
            if n > 30:
                a, p, m = int(rng.integers(0, n - 20)), int(rng.integers(1, 40)), int(rng.integers(10, 200))
                for x in range(a + p, min(n, a + m)):
                    w[x] = w[x - p]
        yield [b"w%d" % x for x in w]


@pytest.mark.parametrize("least, repeats", [(24, 3), (2, 3), (10, 4)])
def test_runs_of_the_grammar_are_all_maximal_runs(least, repeats):
    block = list(periodic_texts(least, 150))
    got = list(zip(*(x.tolist() for x in periodic.text_runs(block, least, repeats))))
    assert got == [(k, *r) for k, words in enumerate(block) for r in brute_runs(words, least, repeats)]
    assert got


def test_extensions_on_the_grammar_are_exact_both_ways():
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 1), (60, 1), (500, 2), (900, 30)):
        symbols = np.r_[kinds, rng.integers(0, kinds, n), kinds + 1].astype(np.int64)
        levels = recompression.grammar(symbols)
        assert len(levels[-1].symbols) == 1
        i, j = np.sort(rng.integers(1, n + 1, (2, 400)), axis=0)
        i, j = i[i < j], j[i < j]
        ahead = recompression.extend(levels, i, j)
        back = [level.backwards() for level in levels]
        behind = recompression.extend(back, n + 2 - j, n + 2 - i)
        for x, y, f, b in zip(i, j, ahead, behind):
            assert (symbols[x : x + f] == symbols[y : y + f]).all() and symbols[x + f] != symbols[y + f]
            assert (symbols[x - b : x] == symbols[y - b : y]).all() and symbols[x - b - 1] != symbols[y - b - 1]


def test_find_runs_takes_odd_rows_and_keeps_other_columns(spark):
    docs = odd_documents(spark).withColumn("runs", F.lit("given")).withColumn("start", F.lit(7))
    rows = periodic.find_runs(docs).collect()
    assert len(rows) == docs.count() and all(r["start"] == 7 for r in rows)
    for r in rows:
        words = WORD.findall(r["text"] or "")
        want = brute_runs(words) if len(words) < 2000 else [(0, 30_000, 1)]
        assert [tuple(x) for x in r["runs"]] == want
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in want)]
        assert r["collapsed"] == " ".join(kept)
    assert periodic.find_runs(empty(spark)).count() == 0


def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL_TABLE}/documents.parquet").limit(120).union(spark.createDataFrame(
        [(None, "a b " * 30, None, None, None), (3, None, None, None, None), (40, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    made = periodic.run_digests(periodic.find_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))))
    planted, want = 0, []
    for d in docs.collect():
        words = WORD.findall(d["text"] or "")
        n, h = len(words), 1 if d["doc_id"] is None else zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(kept))]
        want.append((d["doc_id"], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests))
    assert planted > 3 and any(w[1] for w in want)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)


def brute_top(vectors, wanted, k):
    asked = {}
    for i, v in vectors:
        if i is not None and v is not None and wanted(i):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, x in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in vectors if i is not None and v is not None and i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, chunk, scale", [(64, 8, 1), (1000, 1000, 1), (50, 3, 2**22)])
def test_top_k_equals_brute_force_through_tiles(spark, monkeypatch, block, chunk, scale):
    monkeypatch.setattr(pivots, "RING_ROWS", 16)
    rng = np.random.default_rng(block)
    centres = rng.normal(0, 20, (6, 8))
    rows = [(k, [int(x) * scale for x in np.round(centres[k % 6] + rng.normal(0, 3, 8))]) for k in range(500)]
    rows += [(1000 + k, list(rows[7][1])) for k in range(150)]  # equal vectors
    rows += [(20, rows[1][1]), (20, rows[2][1]), (40, rows[40][1]), (None, rows[3][1]), (2000, None), (2020, []), (2040, [scale, 1])]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, vector array<bigint>, score string")
    got = pivots.top_k(table, F.col("vec_id") % 20 == 0, k=7, pivots=9, block_rows=block, chunk_queries=chunk)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 20 == 0, 7)


def test_top_k_of_few_rows_and_odd_components(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [-0.01, 3.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = table.select("vec_id", pivots.quantised(F.col("embedding")).alias("vector"))
    assert {r["vec_id"]: r["vector"] for r in made.collect() if r["vector"]} == {0: [64, 128], 5: [-1, 192], 6: [64, 128], None: [64, 64]}
    got = [tuple(r) for r in pivots.top_k(made, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, -64 + 128 * 192), (0, 2, 6, 64 * 64 + 128 * 128), (5, 1, 0, -64 + 128 * 192), (5, 2, 6, -64 + 128 * 192)]
    none = empty(spark, "vec_id long, vector array<bigint>")
    assert pivots.top_k(none, F.col("vec_id") % 5 == 0).collect() == []
    # the ends of long
    far = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<double>")
    far = pivots.top_k(far.select("vec_id", pivots.quantised(F.col("embedding")).alias("vector")), F.col("vec_id") == 0)
    assert [(r["vec_id"], r["score"]) for r in far.orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_rings_are_left_out_by_their_bounds():
    rng = np.random.default_rng(1)
    rows = np.round(np.concatenate([rng.normal(c, 1, (400, 4)) for c in (-200, 0, 200)])).astype(np.int64)
    at = pivots.Space(4, 300, float((rows**2).sum(axis=1).max()), rows[[0, 400, 800]].astype(float))
    d = at.distances(rows.astype(float))
    pivot, distance = d.argmin(axis=1), d.min(axis=1)
    order = np.lexsort((distance, pivot))
    asked, counted = rows[[0, 801]], []
    seen = SimpleNamespace(products=lambda q, r: counted.append(len(r)) or pivots.Space.products(at, q, r))
    space = type("Counting", (pivots.Space,), {"products": lambda self, q, r: seen.products(q, r)})(at.width, at.most, at.reach, at.pivots)
    best = pivots.search(space, 5, asked, np.array([0, 801]), np.full(2, pivots.LONG[0]), rows[order], order, pivot[order], distance[order])
    every = asked @ rows.T
    assert all(sorted(every[k][np.arange(1200) != i])[-5:][::-1] == best.scores[k].tolist() for k, i in enumerate((0, 801)))
    assert sum(counted) < 1200


def test_new_queries_are_registered():
    assert {"op11_collocations", "op12_runs", "op13_topk"} <= set(queries.QUERIES)
