"""SimHash, personal data, classifier, pages, media and the pipeline against brute force or on held-out rows."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barscreen.llm import alike, bitslice, classifier, components, htmltext, media, pii, simhash

from .test_text_operators import DOCS, SMALL_TABLE, empty, odd_documents


def grouped(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("words, radius, n, buckets", [(1, 3, 400, 5), (8, 92, 300, 9), (1, 0, 130, 1)])
def test_bit_sliced_links_connect_as_all_pairs_do(words, radius, n, buckets):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, size=(n, words), dtype=np.uint64)
    for i in range(0, n, 2):
        fps[i] = fps[rng.integers(0, n)]
        for b in rng.integers(0, 64 * words, rng.integers(0, radius + 3)):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bucket = np.sort(rng.integers(0, buckets, n))
    near = [(i, j) for i in range(n) for j in range(i) if bucket[i] == bucket[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius]
    got = bitslice.links(bucket, fps, radius)
    assert {tuple(sorted(p, reverse=True)) for p in got} <= set(near)
    assert grouped(got, n) == grouped(near, n)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)] + [(200, 201), (201, 202), (202, 200)]
    found = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)} | {(i, 200) for i in (200, 201, 202)}
    assert len(found) == 41 + 60 + 3


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    given = spark.read.parquet(f"{SMALL_TABLE}/documents.parquet").select("doc_id", "text")
    docs = odd_documents(spark).select(F.col("doc_id") - 100, "text").toDF("doc_id", "text").union(given)
    rows = simhash.simhash_classes(docs.withColumn("source", F.lit(1))).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(brute_fingerprint(r["text"]))
    assert len(rows) == docs.count()
    fps = [int.from_bytes(r["fp"], "big") for r in rows]
    assert all(f in texts[r["doc_id"]] for f, r in zip(fps, rows))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    groups = defaultdict(list)
    for r, g in zip(rows, grouped(near, len(rows))):
        groups[g].append(r)
    for members in groups.values():
        ids = [m["doc_id"] for m in members if m["doc_id"] is not None]
        assert {m["component_id"] for m in members} == {min(ids) if ids else None}


def test_large_buckets_are_dealt_in_chunks_without_losing_links(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[:300] + [rng.choice(words)])) for i in range(60)], "doc_id long, text string")
    nodes = simhash.fingerprints(docs, simhash.SimHash()).groupBy("node", "fp").agg(F.min("doc_id").alias("rep"))
    pairs = lambda n: components.components(simhash.fingerprint_links(nodes, simhash.SimHash(), n)).select("node", "root").distinct().collect()
    assert {tuple(r) for r in pairs(4)} == {tuple(r) for r in pairs(50_000)}


def test_near_copies_leave_one_row(spark):
    rng = random.Random(1)
    base = [" ".join(f"t{rng.randrange(5000)}" for _ in range(400)) for _ in range(12)]
    rows = []
    for i, text in enumerate(base):
        rows += [(10 * i, text), (10 * i + 1, text), (10 * i + 2, text.replace(text.split()[200], "changed")), (10 * i + 2, text)]
    rows += [(None, base[0]), (None, "alone and short"), (None, "alone and short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("clash"))
    left = sorted((r["doc_id"], r["text"]) for r in simhash.survivors(docs).collect() if r["doc_id"] is not None)
    assert left == [(10 * i, t) for i, t in enumerate(base)]
    assert simhash.survivors(docs).where("doc_id is null").count() == 1
    assert simhash.survivors(empty(spark)).count() == 0


def test_columns_that_clash_give_way(spark):
    docs = odd_documents(spark).withColumns({c: F.lit("clash") for c in ("spans", "base_spans", "redacted", "node", "root", "fp", "n")})
    found = pii.find_personal_data(docs).collect()
    assert len(found) == docs.count() and all(r["node"] == "clash" and r["spans"] != "clash" for r in found)
    classes = simhash.simhash_classes(docs).collect()
    assert len(classes) == len(found) and all(r["spans"] == "clash" and r["node"] != "clash" for r in classes)


def test_tiles_connect_what_all_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(alike, "CHUNK_TEXTS", 20)
    rng = np.random.default_rng(3)
    base, sets, root = rng.integers(0, 2**63, 60), [], []
    for g, (count, rate) in enumerate([(90, 0.11), (70, 0.02), (5, 0.1), (60, 0.3), (1, 0.0)]):
        for _ in range(count):
            kept = base[rng.random(60) >= rng.uniform(0, 2 * rate)]
            sets.append(np.unique(np.r_[kept, rng.integers(0, 2**63, 60 - len(kept))]).astype("<u8"))
            root.append(g)
    pairs = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if root[i] == root[j] and (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9
    ]
    groups = spark.createDataFrame(list(enumerate(root)), "node long, root long")
    table = spark.createDataFrame([(k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)], alike.SETS)
    found = [tuple(r) for r in alike.links_within(groups, table, 0.8).collect()]
    assert {tuple(sorted(p, reverse=True)) for p in found} <= set(pairs) and len(found) < 3 * len(sets)
    assert grouped(found, len(sets)) == grouped(pairs, len(sets))
    assert len(set(grouped(pairs, len(sets))[:90])) > 3
    few = rng.permutation(len(sets))[:200]
    counts = alike.common_counts([sets[k] for k in few])
    assert all(counts[a, b] == len(np.intersect1d(sets[few[a]], sets[few[b]])) for a in range(0, 200, 7) for b in range(200))


def test_a_group_of_two_thousand_near_copies_under_the_similarity(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(2000):  # six changed words cost 30 of 96 shingles: copies of each other at 0.3 to 0.6
        copy = list(base)
        for i in rng.sample(range(5, 95), 6):
            copy[i] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    rows += [(2000 + k, t.replace(t.split()[0], "else")) for k, t in rows[:30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r["doc_id"] for r in simhash.survivors(docs).collect()} == set(range(2000))


def naive_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if low <= len(digits) <= high and (kind == 3 or luhn):
                out.append((kind, *m.span()))
    return out


def test_near_copies_are_those_of_the_similarity(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice((8, 12, 30, 120, 400)))]
        texts.append(base)
        for _ in range(6):  # a changed run costs its length and four shingles more
            copy, at = list(base), rng.randrange(len(base))
            for k in range(at, min(len(base), at + max(1, round(rng.choice((0.01, 0.05, 0.08, 0.1, 0.13, 0.17)) * len(base))))):
                copy[k] = word()
            texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    pairs, alike = defaultdict(int), []
    for a, b in itertools.combinations(range(len(texts)), 2):
        if common := len(sets[a] & sets[b]):
            share = common / len(sets[a] | sets[b])
            pairs[min(9, int(10 * share))] += 1
            if share >= 0.8:
                alike.append((a, b))
    assert min(pairs[k] for k in (6, 7, 8)) > 20
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.survivors(docs).collect()}
    wanted = set(grouped(alike, len(texts)))
    assert wanted <= left, "a text that is nobody's copy was dropped"
    assert len(left - wanted) <= len(wanted) // 50


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+-_ (5)é9") for _ in range(rng.randint(0, 40)))
        text += rng.choice(["", "4111111111111111", "1.2.3.4.5", "a@b.c_x@y.z.w", "+1 (017) 555-7713", "4111 1111 1111 1111"])
        assert pii.base_spans(text) == naive_spans(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "a@b.c" * 60_000, "+" * 200_000, "1." * 200_000, "+1" + "(" * 200_000])
def test_patterns_take_linear_time(text):
    start = time.time()
    pii.base_spans(text)
    assert time.time() - start < 5


def test_the_field_finds_repetitions_that_patterns_miss(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    model = pii.Potentials(pii.train(given))
    text = "call +1 (017) 555-7713 today, or later 555-7713 again; order 12345678"
    base = pii.base_spans(text)
    added = set(pii.entity_spans(text, base, model)) - set(base)
    assert {text[a:b] for _, a, b in added} == {"555-7713"}
    assert pii.redact(text, base) == "call [PHONE] today, or later 555-7713 again; order 12345678"


def test_shapes_alone_decide_where_nothing_is_observed():
    model = pii.Potentials([(0, pii.shape("555-4081"), 4, 150), (0, pii.shape("1999"), 0, 150)])
    text = "call 555-4081 now"
    assert pii.entity_spans(text, pii.base_spans(text), model) == [(3, 5, 13)]
    assert pii.entity_spans("in 1999 again", [], model) == []
    assert pii.entity_spans("no node", [], model) == []


def test_personal_data_of_odd_rows(spark):
    docs = odd_documents(spark).union(spark.createDataFrame([(20, "me@x.org 4111111111111111", "a", None)], DOCS))
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        spans = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base_spans"]]
        assert spans == naive_spans(r["text"] or "") and set(r["base_spans"]) <= set(r["spans"])
        assert r["redacted"] == r["text"] or r["doc_id"] == 20
    assert [r["redacted"] for r in rows if r["doc_id"] == 20] == ["[EMAIL] [CARD]"]
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_classifier_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.learn(docs, labels)
    rows = classifier.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    odd = odd_documents(spark)
    scored = classifier.score_quality(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    assert classifier.score_quality(empty(spark), model).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    base = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(classifier.fold_column() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = classifier.learn(docs, labels), classifier.learn(docs, turned)
    assert np.array_equal(one.weights, two.weights) and (one.scale, one.shift) == (two.scale, two.shift)


def summed(x):
    return lambda model: classifier.Sums.of(model.binned(x), model.weights)


def test_risk_of_bad_texts_stays_above_zero():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, len(classifier.FEATURES)))
    good, bad = x[:300], np.concatenate([x[300:800], x[800:] + 4])
    labelled, labels = np.concatenate([x[:200], x[800:] + 4]), np.r_[np.ones(200), np.zeros(100)]
    model = classifier.fit(good, labelled, labels, summed(bad))
    assert model.score(x[300:600]).mean() > 0.7 > 0.3 > model.score(x[850:] + 4).mean()
    p, u = summed(good)(model), summed(bad)(model)
    assert u.loss / u.rows - model.prior * p.loss / p.rows > -0.05
    none = classifier.fit(good[:0], labelled[:0], labels[:0], summed(bad[:0]))
    assert none.score(x[:3]) == pytest.approx(np.full(3, none.prior))


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_comes_from_positive_and_unlabelled_values(share):
    rng = np.random.default_rng(7)
    n = 20_000
    good, bad = rng.normal(2, 1, n), rng.normal(-2, 1, n)
    mixed = np.where(rng.random(n) < share, rng.normal(2, 1, n), bad)
    cells = lambda v: np.bincount(classifier._cells(v), minlength=classifier.CELLS).astype(float)
    assert abs(classifier.estimated_prior(cells(good), cells(mixed)) - share) < 0.06


def test_gradient_is_that_of_the_non_negative_risk():
    rng = np.random.default_rng(3)
    p, u = rng.integers(0, 4, (40, 3)) + 4 * np.arange(3), rng.integers(0, 4, (50, 3)) + 4 * np.arange(3)
    w = rng.normal(0, 0.5, 13)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    value = lambda bins, w: w[bins].sum(1) + w[-1]

    def parts(w, prior):
        return prior * sigmoid(-value(p, w)).mean(), sigmoid(value(u, w)).mean() - prior * sigmoid(value(p, w)).mean()

    for prior, sign in ((0.3, 1), (0.99, None)):
        if sign is None:  # so many good texts that the estimate for bad ones is below zero
            w = w + np.r_[np.zeros(12), 0.0]
            p = np.repeat(u[np.argsort(-value(u, w))][:5], 8, axis=0)
        good, bad = parts(w, prior)
        assert (bad >= 0) == (sign == 1)
        risk = (lambda w: sum(parts(w, prior))) if sign else (lambda w: -parts(w, prior)[1])
        numeric = [(risk(w + e) - risk(w - e)) / 2e-6 for e in 1e-6 * np.eye(13)]
        got = classifier.risk_gradient(classifier.Sums.of(p, w), classifier.Sums.of(u, w), prior)
        assert np.allclose(got, numeric, atol=1e-6)


def test_features_are_plain_counts():
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        solid = sum(c not in " \t\n\r\x0b\x0c" for c in text)
        share = lambda test: sum(map(test, text)) / solid
        return [
            np.log1p(len(words)), solid / len(words), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in ".,;:?'-"),
            share(lambda c: c in "#*$%&<>|@~^=_\\{}[]"), share(lambda c: ord(c) < 128 and not c.isalnum() and c not in ".,;:?'-#*$%&<>|@~^=_\\{}[] \t\n\r\x0b\x0c"),
            share(lambda c: ord(c) >= 128), len(words) / len(lines), len(set(words)) / len(words), max(map(words.count, words)) / len(words),
            len(set(lines)) / len(lines), sum(a == b for a, b in zip(words, words[1:])) / len(words), text.count("|") / len(words),
        ]

    for text in ("One two two THREE, 4.5 | é𝄞 #x\nOne\n \nlast (line)!", "a", "x | y || z\tw\r\nx | y || z\tw\r\n"):
        assert classifier.text_features(text.encode())[:14] == pytest.approx(plain(text))


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 7)
        odds = [rng.choice([-3, -1, -0.5, 0.5, 1, 2]) + rng.random() * 0.01 for _ in range(n)]
        edges = {(i, j): rng.choice([0.3, 1, 1.3, 2]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.45}
        cost = lambda side: sum(max(0, o) if not s else max(0, -o) for o, s in zip(odds, side)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])
        assert cost(htmltext.cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


PAGE = """<html><head><title>T</title></head><body class="post-1"><header class=site><a href=/>Home</a> Site</header><div id=menu><a href=1>One</a>
<a href=2>Two</a></div><div class="cookie-notice">We use cookies.</div><div class=article><h1>Big &amp; title</h1><p>First   para with a
<b>bold</b>word &lt;x&gt; and text.<p>Second para; it goes on.<div class="sidebar">Side</div><p hidden>secret</p><p>Third para.</p>
<script>if (a<b) "</p>"</script><form><label>Mail</label></form></div><section id="comments"><p>Great post!</p></section><footer>&copy; me</footer>"""


def test_main_text_of_pages(spark):
    assert htmltext.main_text(PAGE, {}) == "Big & title First para with a boldword <x> and text. Second para; it goes on. Third para."
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "u", "", "x"), (3, "u", "<p>" * 20_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_main_text(pages).collect()
    assert sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0] and len(got) == 5
    given = spark.read.parquet(f"{SMALL_TABLE}/pages.parquet")
    inside = {r["page_id"]: re.search(r"<article>(.*)</article>", r["html"], re.S)[1] for r in given.collect()}
    from html import unescape

    for r in htmltext.extract_main_text(given).collect():
        plain = re.sub(r"<[^>]*>", "", re.sub(r"<(/?p|/?h1|br)>", " ", inside[r["page_id"]]))
        assert r["text"] == " ".join(unescape(plain).split()) and r["n_chars"] == len(r["text"])
    assert htmltext.extract_main_text(empty(spark, "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("around", ['class="has-sidebar"', 'class="no-ads"', 'class="content-sidebar-wrap"', 'class="layoutWithSidebar"', 'id="search-results"'])
def test_names_round_a_page_keep_its_article(around):
    text = "A sentence of the article, which is long enough to be read as one. " * 4
    menu = "<div class=sidebar><p>One more</p><p>Links</p></div>"
    for inner in ("article", "div"):
        page = f"<body><div {around}><{inner}><p>{text}</p><p>{text}</p></{inner}>{menu}</div></body>"
        found = htmltext.main_text(page, {f: 2.0 for f in range(150)})
        assert found.count("sentence") == 8 and "Links" not in found


def test_forms_are_counted_on_all_pages(spark):
    pages = spark.range(4_000).select(F.col("id").alias("page_id"))
    ids = {r[0] for r in pages.orderBy(F.xxhash64("page_id"), "page_id").limit(2_000).select("page_id").collect()}
    lost = min(set(range(4_000)) - ids)
    html = F.when(F.col("page_id") == lost, "<article><h2>Rare heading of some page here</h2></article>").otherwise("<nav>Menu</nav>")
    assert max(htmltext.train_forms(pages.withColumn("html", html)).values()) > 0


def test_formulas_and_text_behind_open_elements_stay():
    page = "<article><p>Energy <math><mi>E</mi><mo>=</mo><mn>5</mn></math> here.</p><svg><p>Behind it.</p></article>"
    assert htmltext.main_text(page, {}) == "Energy E=5 here. Behind it."


PROSE = "The council met on Monday and agreed, after a long debate, to mend the bridge before the winter sets in."


@pytest.mark.parametrize("page", [
    "<form id='aspnetForm'><article><p>{0}</p><p>{0}</p></article></form>",
    "<dialog open><main><p>{0}</p><p>{0}</p></main></dialog>",
    "<nav><ul><li><a href='/'>Home</a></li></ul><article><p>{0}</p><p>{0}</p></article>",
    "<noscript><article><p>{0}</p><p>{0}</p></article></noscript>",
    "<div class='popup'><p>{0}</p><p>{0}</p></div>",
    "<form id='page'><p>{0}</p><p>{0}</p></form>",
    "<article><p>{0}</p><p>{0}</p></article><section id='comments'>{1}</section>",
    "<article><p>{0}</p><p>{0}</p><section class='comment-list'>{1}</section></article>",
    "<main><p>{0}</p><p>{0}</p></main><div class='comments-area'><article class='comment'>{1}</article></div>",
    "<article><p>{0}</p><p>{0}</p></article><noscript>Please enable JavaScript to view this page.</noscript>",
])
def test_articles_stay_and_comments_go_whatever_stands_around_them(spark, page):
    table = htmltext.train_forms(spark.read.parquet(f"{SMALL_TABLE}/pages.parquet"))
    remarks = "".join(f"<p>I have been saying this for years, and nobody has listened to me so far, number {k}.</p>" for k in range(12))
    assert htmltext.main_text("<html><body>" + page.format(PROSE, remarks) + "</body></html>", table) == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("html", ["<b>" * 40_000 + "<p>x</p>" * 20_000, "<" * 200_000, '<a "' * 80_000, "<ul>" + "<li>x" * 40_000, "<!--" * 50_000])
def test_pages_take_linear_time(html):
    start = time.time()
    htmltext.main_text(html, {})
    assert time.time() - start < 10


def brute_alignments(rows, asked):
    """For each row (queries that align, the best of them), by comparing each query with every recording."""
    prints = {k: media.fingerprint(media.word_frames((t or "").encode())) for k, t in rows}
    keys = {k: media.keys_of(p) for k, p in prints.items()}
    made = {k: media.Recording(keys[k][at := media.landmarks(keys[k])], at, media.kept_bits(p)) for k, p in prints.items()}
    sign = {k: xxhash.xxh128_hexdigest(p.tobytes()) for k, p in prints.items()}
    queries = {sign[k]: k for k in made if k is not None and asked(k) and len(made[k].keys)}
    name = {x: min((k for k in sign if sign[k] == x and k is not None), default=None) for x in sign.values()}
    out = {}
    for k, it in made.items():
        found = [(-h[1], h[2], q, h[0]) for q, i in queries.items() if q != sign[k] and (h := media.aligned(made[i], it))]
        best = min(found, default=None)
        out[k] = (len(found), name[best[2]] if best else None, best and best[3])
    return out


def test_recordings_align_as_brute_force_says(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"n{rng.randrange(3000)}" for _ in range(700)]
    texts = {0: words, 1: words, 50: words[100:500], 3: words[:90], 100: [rng.choice(words) for _ in range(400)], 5: words[200:] + ["x"] * 50, 150: words[40:60]}
    for k in range(200, 400):  # a group of copies of passages, changed here and there
        at = rng.randrange(400)
        texts[k] = [w if rng.random() > 0.04 else f"v{rng.randrange(99)}" for w in words[at : at + rng.randrange(10, 300)]]
    texts |= {k: ["same"] * k for k in (450, 451, 20_000)}
    rows = [(k, " ".join(v)) for k, v in texts.items()] + [(7, None), (8, ""), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("sign", "keys", "n_queries", "rec", "key")})
    want = brute_alignments(rows, lambda k: k % 50 == 0)
    for size in (8192, 20):
        monkeypatch.setattr(media, "BUCKET", size)
        found = media.align_recordings(docs, F.col("doc_id") % 50 == 0).collect()
        assert len(found) == len(rows) and {r["doc_id"]: (r["n_queries"], r["query_id"], r["offset"]) for r in found} == want
    got = {r["doc_id"]: r for r in found}
    assert got[1]["recording_id"] == 0 and got[1]["n_queries"] >= 1
    assert got[7]["n_queries"] == got[None]["n_queries"] == 0
    assert media.align_recordings(empty(spark), F.col("doc_id") % 50 == 0).count() == 0


def test_recall_of_changed_moved_and_short_copies(spark):
    rng = random.Random(9)
    words = lambda n: [f"n{rng.randrange(20_000)}" for _ in range(n)]
    rows, copies = [], []
    for k in range(0, 6000, 50):
        n = (48, 80, 160, 300, 800)[k // 50 % 5]
        base = words(n)
        how = k // 250 % 4
        if how == 0:  # a word in forty changed
            copy = [w if i % 40 != 39 else "changed" for i, w in enumerate(base)]
        elif how == 1:  # inside of a longer recording
            copy = words(rng.randrange(200)) + base + words(rng.randrange(200))
        elif how == 2:  # two thirds of it, elsewhere
            copy = words(50) + base[n // 3 :]
        else:
            copy = base[: n - n // 5] + words(n // 4)
        rows += [(k, " ".join(base)), (k + 1, " ".join(copy))]
        copies.append(k)
    rows += [(100_001 + k, " ".join(words(200))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["query_id"] for r in media.align_recordings(docs, F.col("doc_id") % 50 == 0).collect()}
    found = sum(got[k + 1] == k for k in copies)
    assert found >= 0.9 * len(copies), found / len(copies)
    assert all(got[100_001 + k] is None for k in range(200))


def test_fingerprints_depend_on_the_recording_alone():
    rng = np.random.default_rng(1)
    some = [rng.integers(0, 31, size=(n, 12)).astype(np.float32) for n in (0, 1, 5, 16, 40, 300)]
    assert all(np.array_equal(a, media.fingerprint(x)) for a, x in zip(media.fingerprints(some), some))
    sound = np.sin(2 * np.pi * 440 * np.arange(20_000) / 11_025)
    assert set(media.chroma(sound, 11_025).argmax(1)) == {0}


def test_pipeline_stages_keep_the_columns_and_take_empty_tables(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SMALL_TABLE}/documents.parquet")
    clash = {c: F.lit(i) for i, c in enumerate(("kept", "fp", "node", "size", "copies", "spans", "text2", "row", "component_id"))}
    docs, none = given.withColumns(clash), given.limit(0)
    odd = odd_documents(spark).withColumns({"lang": F.lit("en"), "n_chars": F.lit(None).cast("long")}).select(*given.columns)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SMALL_TABLE)
        assert stage(spark, none, SMALL_TABLE).count() == 0, name
        assert stage(spark, odd, SMALL_TABLE).count() >= 0, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == docs.columns, name
            from barscreen.llm.common import stored

            docs = stored(made, "stage")
    assert hashlib.sha256(b"").hexdigest() and corpus_pipeline.ORACLE_SQL is None


def test_all_bits_of_a_frame_are_compared():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 32, 200, np.uint32)
    key = media.keys_of(prints)
    at = media.landmarks(key)
    for bit in range(32):
        one, two = (media.Recording(key[at], at, media.kept_bits(p)) for p in (prints, prints ^ np.uint32(1 << bit)))
        assert media.aligned(one, two)[2] == 1 / 32


def test_fingerprints_are_packed_and_only_those_a_query_may_meet_are_moved(spark):
    rng = np.random.default_rng(7)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 5000, n)) for n in (1, 5, 40, 800)]
    some = [media.fingerprint(media.word_frames(t)) for t in texts] + [np.zeros(0, np.uint32), rng.integers(0, 1 << 32, 99, np.uint32)]
    for prints in some:
        assert np.array_equal(media.unpacked(media.packed(prints)), prints)
    assert len(media.packed(some[3])) < 0.65 * some[3].nbytes
    recs = spark.createDataFrame([(k * 0x9E3779B97F4A7C15 % (1 << 63) * (-1) ** k, k) for k in range(2000)], "rec long, n int")
    met = media.met_filter(recs.where("n < 100").select("rec"))
    passed = {r["n"] for r in media._once(recs.unionByName(recs).coalesce(1), met).collect()}
    assert passed >= set(range(100)) and len(passed) < 110


def recordings_said_again(rng, n):
    """Words that are said again and again, lines that are, and copies of passages."""
    words = [b"w%d" % k for k in range(400)]
    texts = [b"", b"one two", b"w0 " * 3000]
    while len(texts) < n:
        if len(texts) % 3:
            texts.append(b" ".join(w for _ in range(rng.randrange(3, 12)) for w in [words[int(rng.expovariate(0.2))]] * rng.randrange(20, 60)))
        elif len(texts) % 2:
            texts.append(b" ".join(words[at : at + rng.choice((12, 40))] * rng.randrange(2, 20) if (at := rng.randrange(20)) else words[:9]))
        else:
            texts.append(b" ".join(w for w in words[rng.randrange(200) :] if rng.random() > 0.03))
    return {f"{k:05d}": media.Recording.of(p) for k, p in enumerate(media.fingerprints([media.word_frames(t) for t in texts]))}


@pytest.mark.parametrize("piece", [1 << 18, 60])
def test_a_bucket_finds_what_each_pair_says(monkeypatch, piece):
    monkeypatch.setattr(media, "PIECE", piece)
    made = recordings_said_again(random.Random(3), 160)
    held = media._Bucket()
    for name, it in [*made.items(), *made.items()]:
        held.hold(name, it)
    want = {}
    for name in sorted(made)[1::4]:
        held.ask(name, made[name])
        for other, it in made.items():
            if other != name and (hit := media.aligned(made[name], it)):
                want.setdefault(other, []).append((-hit[1], hit[2], name, hit[0]))
    assert len(want) > 20 and sum(map(len, want.values())) > 100
    assert {held.names[k]: (n, held.best[k]) for k, n in held.counts.items()} == {k: (len(v), min(v)) for k, v in want.items()}
    none = media._Bucket()
    none.ask("x", made["00003"])
    assert none.batch().num_rows == 0


def test_many_recordings_of_words_said_again_take_no_time_a_pair():
    made = recordings_said_again(random.Random(5), 1500)
    held = media._Bucket()
    for name, it in made.items():
        held.hold(name, it)
    start = time.time()
    for name in sorted(made)[3:403]:
        held.ask(name, made[name])
    assert held.counts and time.time() - start < 10  # 600,000 pairs
