"""One JSON document in many byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

import barscreen as bs
from barscreen.sources import documents

from .test_sources import DOCUMENT

SPLIT, OPEN = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture
def splits_of(spark):
    old = {k: spark.conf.get(k) for k in (SPLIT, OPEN)}

    def set_to(size):
        spark.conf.set(SPLIT, str(size))
        spark.conf.set(OPEN, "1")

    yield set_to
    for k, v in old.items():
        spark.conf.set(k, v)


def entries_of(spark, path):
    entries, rest = documents.document_pieces(spark, path)
    found = {}
    for r in entries.orderBy("file", "at", "place").collect():
        found.update(json.loads("{" + r["text"].strip(", \n\t\r") + "}"))
    return found, [json.loads(r["text"]) for r in rest.collect()]


ODD = ['a"b', "x\\", "{[", "]}", '\\"', "", "stocks", "metadata", ":", ",", "é😀", "back\\\\", '"', "tab\t"]


def odd_value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 4 else 3)
    if kind <= 1:
        return rng.choice(ODD)
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return {}
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(ODD) + str(i): odd_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("size", [29, 211, 1 << 20])
def test_pieces_are_the_document_wherever_it_is_split(spark, splits_of, tmp_path, size):
    splits_of(size)
    rng = random.Random(size)
    for k in range(2):
        stocks = {rng.choice(ODD) + f"-{i}": odd_value(rng) if rng.random() < 0.3 else {"info": odd_value(rng), "history": odd_value(rng)} for i in range(5)}
        outer = [("metadata", odd_value(rng)), ("stocks", stocks), ("other", {"stocks": {"no": {"x": 1}}}), ("last", rng.choice([1, "stocks", None]))]
        rng.shuffle(outer)
        document = dict(outer)
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(document, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5), encoding="utf-8")
        found, [rest] = entries_of(spark, str(path))
        assert found == stocks and rest == {**document, "stocks": {}}


def test_no_stocks_no_quotes_and_empty_files(spark, splits_of, tmp_path):
    splits_of(9)
    for k, text in enumerate(["{}", "[1, 2]", '{"stocks": {}}', '{"stocks": null}', '{"metadata": {"stocks": {"A": {}}}}']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        found, rest = entries_of(spark, str(path))
        assert found == {} and rest == [json.loads(text)]
    (tmp_path / "none.json").write_text("")
    assert documents.document_pieces(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_a_long_entry_in_small_pieces(spark, splits_of, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "PIECE_CHARS", 50)
    stocks = {s: {"history": {"index": [f"2024-01-{d:02d}" for d in range(1, 29)]}} for s in "ABC"}
    (tmp_path / "one.json").write_text(json.dumps({"stocks": stocks}))
    assert entries_of(spark, str(tmp_path / "one.json"))[0] == stocks


@pytest.mark.parametrize("size", [197, 1 << 20])
def test_a_document_reads_as_a_bundle_does(spark, splits_of, tmp_path, size):
    splits_of(size)
    (tmp_path / "doc.json").write_text(json.dumps(DOCUMENT, indent=2))
    one, other = (bs.read_snapshot(spark, str(tmp_path / "doc.json"), layout, "Australia/Sydney") for layout in ("bundle", "document"))
    for part in ("bars", "info", "metadata", "errors"):
        assert sorted(map(str, getattr(one, part).collect())) == sorted(map(str, getattr(other, part).collect()))


def test_one_document_uses_several_tasks_and_every_task_a_part(spark, splits_of, tmp_path):
    stocks = {f"S{i}": {"info": {"marketCap": i}, "history": {"columns": ["Close"], "index": ["2024-01-02"], "data": [[i]]}} for i in range(200)}
    (tmp_path / "doc.json").write_text(json.dumps({"metadata": {"data_years_fetched": 1}, "stocks": stocks}))
    size = (tmp_path / "doc.json").stat().st_size
    splits_of(size // 8)
    states = documents.split_states(spark, str(tmp_path / "doc.json"))
    assert states.count() >= 8 and states.where(F.col("section") == "stocks").count() >= 6
    snap = bs.read_snapshot(spark, str(tmp_path / "doc.json"), "document")
    assert {(r.symbol, r.close) for r in snap.bars.collect()} == {(f"S{i}", float(i)) for i in range(200)}
    assert snap.metadata.first()["stock_count"] == 400 and snap.errors.count() == 0


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_a_damaged_entry_costs_itself_and_is_named(spark, splits_of, tmp_path, size):
    splits_of(size)
    good = '{"info": {"marketCap": 1}, "history": {"columns": ["Close"], "index": ["2024-01-02"], "data": [[1.0]]}}'
    text = '{"metadata": {"fetch_date_utc": "2024-01-03"}, "stocks": {"A": %s, "BAD": {"info": 7, "history": "none"}, "WORSE": {"info": {oops}}, "Z": %s}}' % (good, good)
    (tmp_path / "doc.json").write_text(text)
    snap = bs.read_snapshot(spark, str(tmp_path / "doc.json"), "document")
    assert sorted(r.symbol for r in snap.errors.collect()) == ["BAD", "WORSE"]
    assert sorted(r.symbol for r in snap.bars.collect()) == ["A", "Z"]
    # cut off, as by a fetch that was stopped
    (tmp_path / "cut.json").write_text(text[: text.index('"Z"') + 40])
    snap = bs.read_snapshot(spark, str(tmp_path / "cut.json"), "document")
    assert sorted(r.symbol or "-" for r in snap.errors.collect()) == ["-", "BAD", "WORSE", "Z"]
    assert [r.symbol for r in snap.bars.collect()] == ["A"]


def test_unbalanced_brackets_do_not_gather_the_rest(spark, splits_of, tmp_path, monkeypatch):
    splits_of(900)
    monkeypatch.setattr(documents, "RECORD_CHARS", 500)
    text = '{"stocks": {"A": {"info": {}}, "OPEN": {"info": {{{{"x": 1}, ' + ", ".join(f'"S{i}": {{"info": {{}}}}' for i in range(300)) + "}}"
    (tmp_path / "doc.json").write_text(text)
    entries, _ = documents.document_pieces(spark, str(tmp_path / "doc.json"))
    assert max(len(r["text"]) for r in entries.collect()) <= 1000
    assert "OPEN" in {r.symbol for r in bs.read_snapshot(spark, str(tmp_path / "doc.json"), "document").errors.collect()}
