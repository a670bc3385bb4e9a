"""One JSON document with a map of all symbols, read by as many tasks as it has byte ranges.

A document is a single JSON value, so no reader of records can split it. Cut at its quotes it can: Spark's text source
splits a file by bytes and gives whole lines to each split, whatever ends a line. Of the text between two quotes it only
takes a few facts to know what stands before a split: whether the quotes so far leave a string open, how deep brackets
are nested, and which key was last named at the first level. Each split sums them up, for a start inside and outside of
a string; sums over the splits of a file, a row each, give the state every split starts in. Then each split cuts its text
where a symbol's record closes. Records that run over an edge of splits, one for each edge, are put together by a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters of an entry; what unbalanced brackets make longer is damaged and read up to here.
RECORD_CHARS = 256 << 20
#: Characters of a piece at most: longer entries are in several, put together like those that run over splits.
PIECE_CHARS = 4 << 20
#: A name at the first level is told apart by so many characters.
NAME_CHARS = 64
STATE = "flips int, depth_out long, depth_in long, least_out long, name_out string, least_in long, name_in string, open_end boolean"
PIECE = "file string, at long, place long, record boolean, first boolean, last boolean, text string"
_BRACKETS = re.compile(r"[\[\]{}]")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The text between quotes, in order within a split: (file, at, value)."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    return spark.read.option("recursiveFileLookup", True).text(path, lineSep='"').select(*split, "value")


def _by_split(batches):
    """(file, at, batch) for each stretch of rows of one split."""
    for batch in batches:
        if not len(batch):
            continue
        at, file = batch.column("at").to_numpy(), batch.column("file")
        same = np.r_[True, (at[1:] != at[:-1]) | (file[1:].to_numpy(False) != file[:-1].to_numpy(False))]
        cuts = np.r_[np.flatnonzero(same), len(batch)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield file[a].as_py(), int(at[a]), batch.column("value").slice(a, b - a)


def _escapes(value: pa.Array) -> np.ndarray:
    """Whether the quote that ends each segment is escaped: an odd number of backslashes stands before it."""
    ends = np.array(pc.ends_with(value, "\\"), bool)
    for k in np.flatnonzero(ends).tolist():
        text = value[k].as_py()
        ends[k] = (len(text) - len(text.rstrip("\\"))) % 2
    return ends


def _nesting(value: pa.Array) -> np.ndarray:
    """By how much the brackets of each segment nest deeper."""
    count = lambda mark: np.array(pc.count_substring(value, mark), np.int64)
    return count("{") + count("[") - count("}") - count("]")


def _summary(batches):
    """A row for each split: what it changes, if it starts outside or inside of a string."""
    now, state = None, None

    def row():
        flips, escaped, depth, least, name = state
        columns = [flips, depth[0], depth[1], least[0], name[0], least[1], name[1], escaped]
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, [*now, *columns]))], schema=_ARROW)

    for file, at, value in _by_split(batches):
        if now != (file, at):
            if now is not None:
                yield row()
            now, state = (file, at), [0, False, [0, 0], [None, None], [None, None]]
        escaped, deeper = _escapes(value), _nesting(value)
        parity = (state[0] + np.r_[0, np.cumsum(~escaped)]) % 2
        continued = np.r_[state[1], escaped[:-1]]
        for start in (0, 1):  # outside, inside
            inside = (parity[:-1] + start) % 2 == 1
            depth = state[2][start] + np.cumsum(np.where(inside, 0, deeper))
            if inside.any():
                least = int(depth[inside].min())
                if state[3][start] is None or least <= state[3][start]:
                    k = int(np.flatnonzero(inside & (depth == least))[-1])
                    state[3][start], state[4][start] = least, _name(value[k].as_py(), continued[k])
            state[2][start] = int(depth[-1])
        state[0], state[1] = int(parity[-1]), bool(escaped[-1])
    if now is not None:
        yield row()


_NAMES = ["file", "at", "flips", "depth_out", "depth_in", "least_out", "name_out", "least_in", "name_in", "open_end"]
_KINDS = {"file": pa.string(), "flips": pa.int32(), "name_out": pa.string(), "name_in": pa.string(), "open_end": pa.bool_()}
_ARROW = pa.schema([(n, _KINDS.get(n, pa.int64())) for n in _NAMES])


def _name(text: str, continued: bool) -> str:
    """A string as a key; one that an escaped quote continues is none of those that are looked for."""
    return ("\\" if continued else "") + text[:NAME_CHARS]


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, inside, depth, section) for each split of the documents: the state in which it starts.

    A row a split: windows over them order the splits of one file, not its text.
    """
    sums = _segments(spark, path).mapInArrow(_summary, f"file string, at long, {STATE}")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2
    known = sums.withColumn("inside", inside)
    for c in ("depth", "least", "name"):
        known = known.withColumn(c, F.when(F.col("inside") == 1, F.col(f"{c}_in")).otherwise(F.col(f"{c}_out")))
    known = known.withColumn("start", F.coalesce(F.sum("depth").over(before), F.lit(0)))
    top = F.when(F.col("start") + F.col("least") == 1, F.col("name"))
    return known.select(
        "file", "at", (F.col("inside") == 1).alias("inside"), F.col("start").alias("depth"),
        F.last(top, ignorenulls=True).over(before).alias("section"),
        F.coalesce(F.lag("open_end").over(Window.partitionBy("file").orderBy("at")), F.lit(False)).alias("continued"),
    )


class _Cutter:
    """Cuts the text of one split into pieces: entries of the wanted section, and whatever else there is."""

    def __init__(self, file: str, at: int, state: tuple, wanted: str):
        self.file, self.at, self.wanted = file, at, wanted
        self.inside, self.depth, self.section, self.continued = state
        self.record = self.section == wanted and self.depth >= 2
        self.first, self.place = at == 0, 0
        self.rows: list[tuple] = []
        self.held: list[str] = []
        self.chars = 0

    def hold(self, texts: list[str]) -> None:
        self.held += texts
        self.chars += sum(map(len, texts))
        if self.chars > PIECE_CHARS:
            self.close(False, self.record)

    def close(self, last: bool, record: bool) -> None:
        """End a piece, ``last`` if its entry ends with it; ``record`` says what comes next."""
        text = "".join(self.held)
        if not (self.record and self.first and last and not text.strip(" ,\t\r\n")):
            self.rows.append((self.file, self.at, self.place, self.record, self.first, last, text))
            self.place += 1
        self.held, self.chars, self.first, self.record = [], 0, last, record

    def add(self, value: pa.Array) -> None:
        escaped, deeper = _escapes(value), _nesting(value)
        parity = (int(self.inside) + np.r_[0, np.cumsum(~escaped)]) % 2
        inside = parity[:-1] == 1
        after = self.depth + np.cumsum(np.where(inside, 0, deeper))
        before = np.r_[self.depth, after[:-1]]
        texts = [text + '"' for text in value.to_pylist()]
        # brackets around the section and its entries, and names at the first level
        marks = ~inside & (np.minimum(before, after) <= 3) & np.array(pc.match_substring_regex(value, _BRACKETS.pattern), bool)
        names = inside & (after == 1)
        done = 0
        for k in np.flatnonzero(marks | names).tolist():
            self.hold(texts[done:k])
            if names[k]:
                self.section = _name(texts[k][:-1], bool(escaped[k - 1]) if k else self.continued)
                self.hold(texts[k : k + 1])
            else:
                self.cut(texts[k], int(before[k]))
            done = k + 1
        self.hold(texts[done:])
        self.inside, self.depth, self.continued = bool(parity[-1]), int(after[-1]), bool(escaped[-1])

    def cut(self, text: str, depth: int) -> None:
        """Text outside of strings that has brackets: pieces end after ``{`` of the section, ``}`` of an entry, before ``}`` of the section."""
        done = 0
        for mark in _BRACKETS.finditer(text):
            depth += 1 if mark[0] in "{[" else -1
            opens = mark[0] == "{" and depth == 2 and not self.record and self.section == self.wanted
            if opens or (self.record and depth in (1, 2) and mark[0] == "}"):
                at = mark.start() if depth == 1 else mark.end()
                self.hold([text[done:at]])
                self.close(True, depth == 2)
                done = at
        self.hold([text[done:]])


def document_pieces(spark: SparkSession, path: str, section: str = "stocks") -> tuple[DataFrame, DataFrame]:
    """The entries of the object that each JSON document at ``path`` holds under ``section``, and the documents without them.

    Entries: (file, at, place, text), the text without braces around it, maybe with commas at its ends; what is no
    object comes together with the entry before or after it. Of an entry that runs on for over ``RECORD_CHARS``
    characters, as unbalanced brackets leave it, the text is cut short. Documents: (file, text).

    Two passes read the files; what the second finds is stored, so that nothing else reads them. Compressed files are
    one split each.
    """
    states = split_states(spark, path).collect()  # a row for each split, as many as the scan has tasks
    known = {(r["file"], r["at"]): (r["inside"], r["depth"], r["section"], r["continued"]) for r in states}

    def work(batches):
        cutter = None

        def rows():
            made, cutter.rows = cutter.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _PIECES)], _PIECE_NAMES)

        for file, at, value in _by_split(batches):
            if cutter is None or (cutter.file, cutter.at) != (file, at):
                if cutter is not None:
                    cutter.close(False, False)
                    yield rows()
                cutter = _Cutter(file, at, known[file, at], section)
            cutter.add(value)
            if len(cutter.rows) >= 100:
                yield rows()
        if cutter is not None:
            cutter.close(False, False)
            yield rows()

    stored = scratch_path(spark, "pieces")
    _segments(spark, path).mapInArrow(work, PIECE).write.parquet(stored)
    pieces = spark.read.schema(PIECE).parquet(stored)
    whole = pieces.where("record and first and last").select("file", "at", "place", "text")
    entries = whole.unionByName(_joined(pieces.where("record and not (first and last)")))
    rest = pieces.where("not record").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "place", "text"))).alias("p"))
    text = F.array_join("p.text", "")
    # the mark that stands for the end of the last segment
    return entries, rest.select("file", F.substr(text, F.lit(1), F.length(text) - 1).alias("text"))


def _joined(parts: DataFrame) -> DataFrame:
    """Entries of which splits hold a part each. Their order is found without their texts."""
    order = Window.partitionBy("file").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    keys = parts.select("file", "at", "place", F.col("first").cast("int").alias("first"), F.length("text").alias("chars"))
    numbered = keys.withColumn("number", F.sum("first").over(order))
    whole = Window.partitionBy("file", "number").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    placed = numbered.withColumns({"start": F.first(F.struct("at", "place")).over(whole), "before": F.sum("chars").over(whole)})
    begun = (F.col("start.at") == F.col("at")) & (F.col("start.place") == F.col("place"))  # however long, its name is there
    within = placed.where((F.col("before") <= RECORD_CHARS) | begun).select("file", "at", "place", "start")
    texts = parts.select("file", "at", "place", "text").join(within, ["file", "at", "place"])
    joined = texts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "place", "text"))).alias("p"))
    return joined.select("file", "start.at", "start.place", F.array_join("p.text", "").alias("text"))


_PIECE_NAMES = ["file", "at", "place", "record", "first", "last", "text"]
_PIECES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
