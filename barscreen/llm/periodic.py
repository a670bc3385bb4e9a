"""Periodic runs of words: stretches that repeat one sequence of words three times or more, found by recompression.

A task numbers the words of a block of texts, compresses them to a run-length grammar (``recompression``), and extends
the places of a harmonic grid by longest common extensions on it. Texts stay in their partitions: nothing is shuffled.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import let, small_batches, words
from .recompression import runs

#: Words whose runs are searched together; a longer text is searched alone.
BLOCK_WORDS = 1 << 20
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def _blocks(texts: list[bytes | None]):
    """Lists of the words of each text, as many texts at a time as a block holds."""
    block, size = [], 0
    for text in texts:
        found = (text or b"").split()
        if block and size + len(found) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(found)
        size += len(found)
    if block:
        yield block


def text_runs(block: list[list[bytes]], least: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of each text, given as lists of words."""
    numbers: dict[bytes, int] = {}
    for found in block:
        for word in found:
            if word not in numbers:
                numbers[word] = len(numbers)
    ends = count(len(numbers))  # symbols that occur once, around each text
    symbols, starts = [np.array([next(ends)], np.int64)], [1]
    for found in block:
        symbols += [np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)), np.array([next(ends)], np.int64)]
        starts.append(starts[-1] + len(found) + 1)
    return runs(np.concatenate(symbols), np.array(starts, np.int64), least, repeats)


def find_runs(docs: DataFrame, *, text: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period, by start and period) and ``collapsed`` (string).

    A run is a maximal stretch of words with smallest period q, of ``repeats`` (3 or more) times q and ``least`` words at least.
    Words are separated by ASCII white space and numbered from 0. ``collapsed`` has the words, joined by one space,
    without those that any run contains after its first q words.

    Null, empty and white texts have no runs and collapse to the empty text. Texts are whole, however long; one text is
    one task's work. Equal rows have equal results, and an empty table gives an empty table. Other columns stay as they
    are; given columns named runs or collapsed are replaced.
    """
    if repeats < 3:
        raise ValueError("a run has three periods or more")
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("runs", "collapsed")]

    def work(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            offsets, parts, collapsed = [0], [], []
            for block in _blocks(texts):
                owner, *found = text_runs(block, least, repeats)
                parts.append(np.stack(found))
                cuts = np.searchsorted(owner, np.arange(len(block) + 1))
                offsets += (offsets[-1] + cuts[1:]).tolist()
                for k, has in enumerate(block):
                    if cuts[k] < cuts[k + 1]:
                        drop = np.zeros(len(has) + 1, np.int64)
                        start, length, period = (f[cuts[k] : cuts[k + 1]] for f in found)
                        np.add.at(drop, start + period, 1)
                        np.add.at(drop, start + length, -1)
                        has = [has[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(has))
            start, length, period = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
            made = [lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "runs", "collapsed"])

    given = docs.select(*rest)
    schema = StructType([*given.schema.fields, StructField("runs", RUNS), StructField("collapsed", StringType())])
    return given.mapInArrow(work, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten (by hash) its words with a tail that repeats; a null id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = words(text)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(
            F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")))

    changed = let(split, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, changed).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Numbers and digests of ``runs`` and ``collapsed``: the run with the greatest exact exponent, the first of such."""
    ratio = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    earlier = lambda a, b: (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
    better = lambda a, b: (ratio(a, b) > 0) | ((ratio(a, b) == 0) & earlier(a, b))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda m, r: F.when(better(r, m), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
