"""Personal data: base patterns, then a skip-chain conditional random field over each document.

Nodes are the words that hold a digit or an at-sign. A word in a base match is observed with that kind. Neighbours in
the text share a chain edge; words that repeat, however far apart, share a skip edge: each with the next of the same
digits or the same letters. Loopy belief propagation spreads the labels, and an unobserved word whose entity label is
likelier than none becomes a span of its own.

Potentials are trained on the whole corpus, piece by piece: how often words of a shape are observed with each label,
and how much oftener linked words agree than chance. Only these counts, of a bounded number of shapes, reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Shapes are hashed to so many numbers: the size of the trained table.
SHAPES = 4096
#: How often an entity is written in a way that the base patterns miss.
MISSED = 0.05
ROUNDS, DAMPING, SETTLED = 50, 0.3, 1e-4
#: A word links to its next repetition if it has so many digits or, with an at-sign, letters and digits.
LINK_CHARACTERS = 4

# Quantifiers are possessive, and a match starts where a run starts: no text takes more than linear time.
LOCAL = "A-Za-z0-9._%+-"
EMAIL_TAIL = rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL, EMAIL_NEXT = re.compile(rf"(?<![{LOCAL}]){EMAIL_TAIL}"), re.compile(EMAIL_TAIL)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
WORD = re.compile(r"[0-9@]\S*")
NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    at = 0
    while found := EMAIL_NEXT.match(text, at) if at else EMAIL.search(text):
        yield found.span()
        at = found.end()
        # a run that goes on behind a match is tried from there; else the next run
        if not EMAIL_NEXT.match(text, at):
            later = EMAIL.search(text, at)
            if not later:
                return
            at = later.start()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    if not HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def shape(word: str) -> int:
    """The bucket of a word's shape: runs of digits by length, runs of letters as one, other characters as they are."""
    plain = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", word))
    return zlib.crc32(plain.encode()) % SHAPES


class Graph:
    """Nodes and edges of one document."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans: list[tuple[int, int]] = []
        for m in WORD.finditer(text):
            a = m.start()
            while a and not text[a - 1].isspace():
                a -= 1
            self.spans.append((a, m.end()))
        words = [text[a:b] for a, b in self.spans]
        self.labels = np.zeros(len(words), np.int64)
        starts = np.array([a for a, _ in self.spans], np.int64)
        ends = np.array([b for _, b in self.spans], np.int64)
        for kind, a, b in reversed(base):  # where kinds overlap, the first as listed
            self.labels[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = kind + 1
        self.shapes = np.array([shape(w) for w in words], np.int64)
        beside = [i for i in range(1, len(words)) if text[ends[i - 1] : starts[i]].isspace() and starts[i] - ends[i - 1] == 1]
        self.chain = np.array([(i - 1, i) for i in beside], np.int64).reshape(-1, 2)
        last: dict[str, int] = {}
        skip, touching = [], set(beside)
        for i, w in enumerate(words):
            key = re.sub(r"[\W_]+", "", w).lower() if "@" in w else NOT_DIGIT.sub("", w)
            if len(key) >= LINK_CHARACTERS:
                if key in last and not (last[key] == i - 1 and i in touching):
                    skip.append((last[key], i))
                last[key] = i
        self.skip = np.array(skip, np.int64).reshape(-1, 2)


def _counts(graph: Graph, into: Counter) -> None:
    for s, y in zip(graph.shapes.tolist(), graph.labels.tolist()):
        into[0, s, y] += 1
    for what, edges in ((1, graph.chain), (2, graph.skip)):
        for a, b in graph.labels[edges].tolist():
            into[what, a, b] += 1


class Potentials:
    """Trained logarithms: of a label given a shape, and of two labels on an edge against chance."""

    def __init__(self, counts: list[tuple[int, int, int, int]]):
        labels = len(KINDS) + 1
        # before anything is counted, a chain edge says nothing and a skip edge that its words agree
        shapes, self.edges = np.full((SHAPES, labels), 0.1), [np.full((labels, labels), 1.0), 0.1 + np.eye(labels)]
        for what, a, b, n in counts:
            (shapes if what == 0 else self.edges[what - 1])[a, b] += n
        for k, e in enumerate(self.edges):
            both = (e + e.T) / 2
            own = both.sum(1)
            self.edges[k] = np.log(both / both.sum()) - np.log(own[:, None] * own[None, :] / own.sum() ** 2)
        chance = shapes / shapes.sum(1, keepdims=True)
        chance[:, 1:] *= MISSED
        self.shapes = np.log(chance)
        # a message favours an entity over none by its edge's largest ratio at most
        self.gains = [max(0.0, float((e[:, 1:] - e[:, :1]).max())) for e in self.edges]

    def may_add(self, graph: Graph) -> bool:
        """Whether some unobserved node can come out as an entity, whatever its neighbours are."""
        unary = self.shapes[graph.shapes]
        most = unary[:, 1:].max(1) - unary[:, 0]
        for edges, gain in zip((graph.chain, graph.skip), self.gains):
            most += gain * np.bincount(edges.ravel(), minlength=len(most))
        return bool((most[graph.labels == 0] > 0).any())


def beliefs(graph: Graph, model: Potentials) -> np.ndarray:
    """Marginals of the labels of every node, by sum-product messages on the loopy graph."""
    n, labels = len(graph.labels), len(KINDS) + 1
    unary = model.shapes[graph.shapes]
    seen = graph.labels > 0
    unary = np.where(seen[:, None], np.where(np.arange(labels) == graph.labels[:, None], 0.0, -50.0), unary)
    edges = np.concatenate([graph.chain, graph.skip])
    pair = np.concatenate([np.repeat(p[None], len(e), 0) for p, e in zip(model.edges, (graph.chain, graph.skip))])
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    messages = np.zeros((len(source), labels))
    total = unary
    for _ in range(ROUNDS):
        sent = (total[source] - messages[back])[:, :, None] + pair
        top = sent.max(1)
        new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - messages).max(initial=0.0)
        messages = DAMPING * messages + (1 - DAMPING) * new
        total = unary.copy()
        np.add.at(total, target, messages)
        if moved < SETTLED:
            break
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def entity_spans(text: str, base: list[tuple[int, int, int]], model: Potentials) -> list[tuple[int, int, int]]:
    """Base spans and those that the field adds, by kind and start."""
    graph = Graph(text, base)
    if not model.may_add(graph):
        return base
    best = beliefs(graph, model).argmax(1)
    added: list[list[int]] = []
    for i in np.flatnonzero((best > 0) & (graph.labels == 0)).tolist():
        a, b = graph.spans[i]
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a == b:
            continue
        kind = int(best[i]) - 1
        if added and added[-1][0] == kind and added[-1][3] == i - 1 and text[added[-1][2] : a].isspace():
            added[-1][2:] = [b, i]
        else:
            added.append([kind, a, b, i])
    return sorted({*base, *((k, a, b) for k, a, b, _ in added)})


def train(docs: DataFrame) -> list[tuple[int, int, int, int]]:
    """Counts (what, a, b, n) for ``Potentials`` over all texts; at most SHAPES x 5 + 50 rows, whatever the corpus."""
    small_batches(docs.sparkSession)

    def work(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or ""
                if HINT.search(text):
                    _counts(Graph(text, base_spans(text)), counts)
        rows = [(*k, n) for k, n in counts.items()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["what", "a", "b", "n"])

    counted = docs.select("text").mapInArrow(work, "what long, a long, b long, n long")
    return [tuple(r) for r in counted.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()]


SPAN = "array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame, counts: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    """``docs`` (text, any others) with ``base_spans``, ``spans`` and ``redacted``; given columns of these names give way.

    Spans are ordered by kind, then start, in code points. ``redacted`` is the text with each run of overlapping
    spans replaced by the kind of its first, as in ``[EMAIL]``. A null text has no spans and stays null; repeated
    rows are read each for itself. ``counts`` are trained on ``docs`` unless given.
    """
    small_batches(docs.sparkSession)
    model_counts = train(docs) if counts is None else counts
    own = ["base_spans", "spans", "redacted"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in own])
    rest = docs.columns

    def work(batches):
        model = Potentials(model_counts)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            columns: list[list] = [[], [], []]
            for x in batch.column("text"):
                text = x.as_py()
                base = base_spans(text or "")
                spans = entity_spans(text, base, model) if text and HINT.search(text) else base
                columns[0].append(named(base))
                columns[1].append(named(spans))
                columns[2].append(redact(text, spans) if spans else text)
            arrays = [pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*rest, *own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{kinds}, base_spans {SPAN}, spans {SPAN}, redacted string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
