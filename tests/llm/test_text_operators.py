"""Chat, mixing, packing, licenses and quality rules against plain routines."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import chat, licenses, mixing, packing, quality_rules

DOCS = "doc_id long, text string, source string, extra string"
SMALL_TABLE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    prose = " ".join(f"word{i % 97} other{i % 31}" for i in range(300))
    rows = [
        (1, prose, "a", None), (1, prose, "a", None), (2, prose, "b", "x"), (3, None, "a", "x"), (4, "", None, "x"),
        (None, "no id here", "b", "x"), (None, None, None, None), (5, " \t\n ", "b", "x"), (6, "one", "a", "x"),
        (7, "MIT License\nAll rights reserved.", "c", "x"), (8, "same line\nsame line\nsame line " * 40, "a", "x"),
        (9, "x" * 200_000, "a", "x"), (10, "w " * 30_000, None, "x"), (11, "é 𝄞 <|endoftext|> don't, 3.5", "b", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_chat_reads_back_what_it_was_given(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "assistant", "a<|im_sep|>"), (1, 2, "assistant", None), (1, 3, "assistant", "<"),
        (1, 3, "assistant", "<"), (1, 4, "us\ner<|nl|>", "<\\\\|x<|<\\|im_end|>\n"), (None, None, None, None), (2, None, "assistant", "é😀"),
        (3, 1, "user", ""), (3, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.format_conversations(turns)
    back = made.select("conv_id", chat.parsed(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt"), "formatted", "segments")
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    for row in back.collect():
        assert [tuple(t) for t in row["turns"]] == want[row["conv_id"]]
        assert row["learnt"] == "".join(x for r, x in want[row["conv_id"]] if r == "assistant")
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert chat.format_conversations(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def test_adjacent_turns_of_a_role_are_one_message(spark):
    rows = [(1, k, "user" if k < 3 else "assistant", str(k)) for k in range(5)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = made.first()["formatted"]
    assert text.count("<|im_start|>") == 2 and text.count("<|im_sep|>") == 3


def shares(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        over = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / over for s in names}
        more = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12)}
        if more <= full:
            return target
        full |= more


@pytest.mark.parametrize("which", ["odd", "given"])
def test_mixing_takes_each_sources_target(spark, which):
    docs = odd_documents(spark) if which == "odd" else spark.read.parquet(f"{SMALL_TABLE}/documents.parquet")
    clash = {c: F.lit(7) for c in ("room", "last", "epochs", "start", "mix_key", "given_0")}
    clashing = docs.withColumns({**clash, **{c: F.lit("clash") for c in ("taken", "size", "target", "copies")}})
    rows = mixing.mix_sources(clashing).collect()
    assert all(r[c] == 7 for r in rows for c in clash) and sorted(rows[0].asDict()) == sorted(clashing.columns + ["source_size"])
    assert len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["copies"] <= 3 and (r["copies"] > 0) == (r["taken"] > 0)
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = shares(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"] or 0, r["text"] or "", r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix_sources(empty(spark)).count() == 0


@pytest.mark.parametrize("which", ["odd", "given"])
def test_packing_places_every_id_once(spark, which):
    from tokenizers import Tokenizer

    docs = odd_documents(spark) if which == "odd" else spark.read.parquet(f"{SMALL_TABLE}/documents.parquet")
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack_documents(docs.coalesce(1), packing.vocabulary()).collect()
    ids = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        ids[d["doc_id"]].append(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1])
    whole = defaultdict(int)
    for r in rows:
        assert any(
            len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            for x in ids[r["doc_id"]]
        )
        whole[r["doc_id"]] += r["length"]
    assert whole == {k: sum(map(len, v)) for k, v in ids.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    short = 0
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([n for _, n, _ in parts])
        assert [o for o, _, _ in parts] == [0, *ends[:-1]] and ends[-1] <= parts[0][2] <= 2048
        short += ends[-1] < parts[0][2]
    assert short <= 1  # one partition here
    assert packing.pack_documents(empty(spark), packing.vocabulary()).count() == 0
    clashing = docs.withColumns({c: F.lit("clash") for c in ("start", "tier", "sequence_id")}).coalesce(1)
    again = packing.pack_documents(clashing, packing.vocabulary())
    assert again.columns == ["doc_id", *[c.split()[0] for c in packing.OUT.split(", ")]] and again.count() == len(rows)


def test_names_of_special_tokens_in_other_cases_are_ordinary_text():
    ids = packing.WordIds(packing.vocabulary())
    for text in ("a <|EndOfText|> b", "x<|STARTOFTEXT|>", "a <|endoftext|> b", "plain Words."):
        assert ids.encode([text]) == [ids.whole(text)]


def test_words_encoded_together_have_the_ids_of_each_alone():
    words = "plain Words. Straße İstanbul ǅ ﬁne ªº 한글 하 Å é naïve don't x.y 3,5 a, . ,, 漢字 İ ſ ẞ ab's".split(" ")
    ids = packing.WordIds(packing.vocabulary())
    for texts in ([" ".join(words)], words, [" ".join(words[:5]), "", " ".join(w for w in words if w.isalpha())]):
        assert packing.WordIds(packing.vocabulary()).encode(texts) == [ids.whole(t) for t in texts]


def test_step_groups_hold_the_same_tokens(spark):
    docs = spark.createDataFrame([(i, "a " * (20 + 37 * i % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs, packing.vocabulary(), group_tokens=8192)
    groups = rows.groupBy("tier", "step_group").agg(F.sum("length").alias("n")).collect()
    last = {t: max(g["step_group"] for g in groups if g["tier"] == t) for t in {g["tier"] for g in groups}}
    assert {g["n"] for g in groups if g["step_group"] < last[g["tier"]]} <= {8192}


def brute_license(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, places, base = word.findall(low), [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                places.append(k)
                base.add(label)
    labels, share = set(base), 0.0
    for line in low.split("\n"):
        held = set(word.findall(line))
        for label, template in licenses.TEMPLATES:
            own = set(word.findall(template.lower()))
            if len(held & own) >= 0.8 * len(own) - 1e-9:
                labels.add(label)
                share = max(share, len(held & own) / len(own))
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else share


def test_license_scan_equals_brute_force(spark):
    given = spark.read.parquet(f"{SMALL_TABLE}/documents.parquet").select("doc_id", "text")
    more = [(-1, "permission is granted free of charge to any person obtaining a copy of this software and documentation files"), (-2, "Mit license mit LICENSE")]
    docs = odd_documents(spark).select("doc_id", "text").union(given).union(spark.createDataFrame(more, given.schema))
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute_license(r["text"])) for r in docs.collect()), key=str)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def brute_rules(text):
    text = text or ""
    words, windows, covered = WORD.findall(text), defaultdict(list), set()
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    for places in windows.values():
        if len(places) > 1:
            for k in places:
                covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_wrapped_notices_match(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated\ndocumentation files, to deal"
    bsd = "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    words = bsd.replace("\n", " ").split()
    apart = " filler words between\n".join(words)  # the words of a notice, all over a text
    docs = spark.createDataFrame([(1, mit), (2, "first\n\n" + bsd), (3, apart), (4, "no\nnotice")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"] >= 0.8) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("mit", True), 2: ("bsd", True), 3: ("", False), 4: ("", False)}


def test_quality_rules_equal_brute_force(spark):
    given = spark.read.parquet(f"{SMALL_TABLE}/documents.parquet").select("doc_id", "text")
    docs = odd_documents(spark).select("doc_id", "text").union(given).withColumn("kept", F.lit("clash"))
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{SMALL_TABLE}/labels.parquet"))
    rows = quality_rules.quality_rules(docs, trusted).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[x] for x in names) == brute_rules(r["text"])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(empty(spark), trusted).count() == 0


def test_log_likelihood_ratio_is_that_of_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, "a c"), (4, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    got = {r["doc_id"]: r["llr"] for r in quality_rules.quality_rules(docs, trusted, pseudo=1.0).collect()}
    grams = {1: ["a", "b", "a", "a b", "b a"], 2: ["c", "d", "c d"], 3: ["a", "c", "a c"], 4: []}
    every = [g for v in grams.values() for g in v]
    share = len(grams[1]) / len(every)
    weight = {g: math.log((grams[1].count(g) + 1) / (every.count(g) * share + 1)) for g in every}
    for k, v in grams.items():
        assert got[k] == pytest.approx(sum(weight[g] for g in v) / len(v) if v else 0.0)


def test_trusted_ids_take_no_doubtful_row(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, None), (5, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert sorted(r[0] for r in quality_rules.trusted_ids(labels).collect()) == [1, 4]
    assert quality_rules.trusted_ids(labels, 1).count() == 1
