"""Chroma fingerprints of recordings, and their alignment.

A recording is a run of frames, each the energy of the 12 pitch classes. Frames are smoothed, and 16 filters over an
integral image of them compare areas of time and pitch; two bits from each pack into one integer a frame. Landmarks are
the frames at which two integers have the least hash among their neighbours, the same ones wherever a passage occurs. Recordings that
share landmarks vote for the offset between them; at the offset with most votes the bits of all frames that overlap are
compared, block by block.

A query aligns with a recording if at the offset with most votes they share ``VOTES`` of the query's landmarks or more,
and ``SHARE`` of the query's frames or more lie in blocks that differ in ``BIT_ERROR`` of their bits at most. To reach
the first, one of the query's rarest landmarks must be shared: only those are looked up. Recordings that have one are dealt to
buckets, each to one, by the most frequent of these, so that copies mostly lie together; a query goes to the buckets that hold one of its
rarest landmarks. So no pair ever becomes a row: a bucket gives each recording's number of queries and the best of them.
It works on a query and all of its recordings at once: the landmarks of each kind that both have bound the votes, and only
recordings within that bound get a histogram of offsets. There, landmarks that follow one another with one key, as a word
that is said again and again leaves them, are a run: two runs add a trapezoid, given by its four corners.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_intdigest

from .common import small_batches, stored

PITCHES = 12
#: Weights by which a frame's neighbours are mixed in.
SMOOTHING = (1, 3, 4, 3, 1)
#: Frames that a fingerprint looks at.
SPAN = 16
#: Filters by rule: of six shapes in turn, over these widths in frames, bands that step through the octave.
FILTERS = tuple((k % 6, (3 * k) % 9, 2 + 2 * (k % 2), (4, 8, 12, 16)[k % 4]) for k in range(16))
#: Frames that are worked on at once.
BLOCK = 1 << 17
#: Where the logarithm of a filter's two areas is cut into four levels.
LEVEL = 0.12
#: Frames among which a landmark has the least hash.
WINDOW = 24
#: Frames between the two integers of a landmark.
APART = 4
VOTES, SHARE, BIT_ERROR = 0.25, 0.5, 0.2
#: Frames of a block whose bits are compared together.
BLOCK_FRAMES = 16
#: Bits of each frame's integer; all of them are compared.
FRAME_BITS = 32
#: Recordings of a bucket, about: a task holds them while queries pass by.
BUCKET = 2048
#: Offsets, pairs of runs, or frames that a query is worked on at once with.
PIECE = 1 << 18
#: Bits of the filter of recordings that a query may align with: 4 MB, whatever the table.
FILTER_BITS = 1 << 25
#: Where the places of a recording in it begin in its 64 bits.
FILTER_SHIFTS = (0, 19, 38)


def chroma(samples: np.ndarray, rate: int, size: int = 4096, hop: int = 1365) -> np.ndarray:
    """(frames, 12) from samples of sound: the spectrum's energy between 28 Hz and 3520 Hz, by pitch class."""
    count = max(0, (len(samples) - size) // hop + 1)
    if not count:
        return np.zeros((0, PITCHES), np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(samples, size)[:: hop][:count] * np.hanning(size)
    energy = np.abs(np.fft.rfft(windows)) ** 2
    f = np.fft.rfftfreq(size, 1 / rate)
    heard = (f >= 28) & (f <= 3520)
    pitch = np.round(12 * np.log2(f[heard] / 440)).astype(int) % PITCHES
    out = np.zeros((count, PITCHES))
    np.add.at(out.T, pitch, energy[:, heard].T)
    return out.astype(np.float32)


def word_frames(text: bytes) -> np.ndarray:
    """A text as a recording: each word sounds for one frame, a chord that its hash spreads over the pitch classes."""
    words = text.split()
    h = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return ((h[:, None] >> (np.uint64(5) * np.arange(PITCHES, dtype=np.uint64))) & np.uint64(31)).astype(np.float32)


def fingerprints(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """For each recording an integer of 32 bits for each frame that begins a span, one at least; none without frames.

    Recordings are laid out one after another, with silence between, and worked on together. All sums are of
    integers, so a recording's fingerprint doesn't depend on what lies beside it.
    """
    lengths = np.array([len(x) for x in recordings], np.int64)
    if not lengths.sum():
        return [np.zeros(0, np.uint32) for _ in recordings]
    starts = np.cumsum(lengths + SPAN + 4) - lengths - SPAN - 2
    tape = np.zeros((PITCHES, int((lengths + SPAN + 4).sum())), np.int64)
    for x, at in zip(recordings, starts):
        loud = np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        tape[:, at : at + len(x)] = np.rint(1000 * x / loud).T
    smooth = sum(w * np.roll(tape, k - 2, axis=1) for k, w in enumerate(SMOOTHING))
    image = np.zeros((PITCHES + 1, tape.shape[1] + 1), np.int64)
    image[1:, 1:] = smooth.cumsum(1).cumsum(0)
    n = tape.shape[1] - SPAN + 1

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[p1, t1 : t1 + n] - image[p1, t0 : t0 + n] - image[p0, t1 : t1 + n] + image[p0, t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for k, (kind, low, height, w) in enumerate(FILTERS):
        high, half = low + height, low + height // 2
        whole = area(0, w, low, high)
        if kind == 0:  # a band against its share of all pitches
            one, two = whole, area(0, w, 0, PITCHES) * height / PITCHES
        elif kind == 1:  # low half, high half
            one, two = area(0, w, low, half), area(0, w, half, high)
        elif kind == 2:  # early half, late half
            one, two = area(0, w // 2, low, high), area(w // 2, w, low, high)
        elif kind == 3:  # the two diagonals
            one = area(0, w // 2, low, half) + area(w // 2, w, half, high)
            two = whole - one
        elif kind == 4:  # the middle of the time, and what is around it
            one = area(w // 4, 3 * w // 4, low, high)
            two = whole - one
        else:  # a band and another one
            other = (low + 6) % 9
            one, two = whole, area(0, w, other, other + height)
        value = np.log(np.maximum(one, 1) / np.maximum(two, 1))
        level = (value > -LEVEL).astype(np.uint32) + (value > 0) + (value > LEVEL)
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * k)  # neighbouring levels differ in one bit
    return [out[a : a + max(1, m - SPAN + 1)].copy() if m else np.zeros(0, np.uint32) for a, m in zip(starts, lengths)]


def fingerprint(frames: np.ndarray) -> np.ndarray:
    return fingerprints([frames])[0]


def keys_of(prints: np.ndarray) -> np.ndarray:
    """A key for each frame, by its integer and the one ``APART`` frames later (or the last): neighbours' integers are much alike."""
    if not len(prints):
        return np.zeros(0, np.int32)
    later = prints[np.minimum(np.arange(len(prints)) + APART, len(prints) - 1)]
    h = (prints.astype(np.uint64) << np.uint64(32) | later.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def landmarks(keys: np.ndarray) -> np.ndarray:
    """Places of landmarks: the frames with the least key of some window of frames, the last of equals."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    h = keys.view(np.uint32)
    size = min(WINDOW, n)
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], size)
    return np.unique(n - 1 - (view.argmin(1) + np.arange(len(view))))


def kept_bits(prints: np.ndarray) -> np.ndarray:
    """The bits of each frame that are kept for comparison: all of its integer's."""
    return prints.astype(np.uint32)


def packed(prints: np.ndarray) -> bytes:
    """A fingerprint in about half its bytes: bit by bit what changes from frame to frame, as the areas of neighbours overlap."""
    change = prints.astype("<u4")
    change[1:] ^= prints[:-1]
    planes = np.unpackbits(change.view(np.uint8).reshape(-1, 4), axis=1).T
    return zlib.compress(np.packbits(planes).tobytes(), 1)


def unpacked(text: bytes) -> np.ndarray:
    """The fingerprint that ``packed`` has made ``text`` of."""
    planes = np.unpackbits(np.frombuffer(zlib.decompress(text), np.uint8)).reshape(FRAME_BITS, -1)
    change = np.packbits(planes.T, axis=1).reshape(-1).view("<u4")
    return np.bitwise_xor.accumulate(change).astype(np.uint32)


def fingerprint_recordings(recordings: DataFrame, frames, column: str) -> DataFrame:
    """``recordings`` with ``sign`` (of the whole fingerprint), ``keys`` of landmarks, and ``bits`` (``packed``), for ``column``.

    ``frames`` turns a value of the column, as bytes, into frames; null is an empty recording, without landmarks.
    """
    small_batches(recordings.sparkSession)
    rest = [c for c in recordings.columns if c != column]

    def work(batches):
        many = pa.list_(pa.int32())
        for batch in batches:
            signs, keys, bits, found, held = [], [], [], [], []
            for x in batch.column(column).cast(pa.binary()):
                held.append(frames(x.as_py() or b""))
                if sum(map(len, held)) >= BLOCK:
                    found += fingerprints(held)
                    held = []
            for prints in found + fingerprints(held):
                key = keys_of(prints)
                signs.append(f"{xxh128_intdigest(prints.tobytes()):032x}")
                keys.append(key[landmarks(key)])
                bits.append(packed(kept_bits(prints)))
            made = [pa.array(signs, pa.string()), pa.array(keys, many), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "sign", "keys", "bits"])

    kinds = ", ".join(f"`{c}` {recordings.schema[c].dataType.simpleString()}" for c in rest)
    return recordings.select(*rest, column).mapInArrow(work, f"{kinds}, sign string, {MARKS}")


MARKS = "keys array<int>, bits binary"


def needed(n: Column) -> Column:
    """Landmarks that a query of ``n`` must share."""
    return F.greatest(F.ceil(n * F.lit(VOTES)), F.lit(1)).cast("int")


class Recording:
    """Landmarks of a recording in the order of their keys, and its bits."""

    def __init__(self, keys: np.ndarray, ats: np.ndarray, bits: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.ats, self.bits = keys[order], ats[order].astype(np.int64), bits

    @classmethod
    def of(cls, bits: np.ndarray) -> Recording:
        """Landmarks follow from the bits, so these alone are moved."""
        keys = keys_of(bits)
        at = landmarks(keys)
        return cls(keys[at], at, bits)


def aligned(one: Recording, two: Recording) -> tuple[int, int, float] | None:
    """(offset, landmarks shared there, share of differing bits) if ``one`` aligns with ``two``, from the histogram of offsets.

    This says what is meant, for one pair; ``_Bucket`` finds the same for a query and many recordings.
    """
    first = np.searchsorted(two.keys, one.keys, "left")
    count = np.searchsorted(two.keys, one.keys, "right") - first
    if count.sum() < max(1, ceil(VOTES * len(one.keys))):
        return None
    place = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    offsets, votes = np.unique(two.ats[place] - np.repeat(one.ats, count), return_counts=True)
    best = np.lexsort((offsets, np.abs(offsets), -votes))[0]
    offset, shared = int(offsets[best]), int(votes[best])
    if shared < max(1, ceil(VOTES * len(one.keys))):
        return None
    low, high = max(0, -offset), min(len(one.bits), len(two.bits) - offset)
    wrong = np.bitwise_count(one.bits[low:high] ^ two.bits[low + offset : high + offset])
    edges = np.r_[0, np.arange(BLOCK_FRAMES - low % BLOCK_FRAMES, high - low, BLOCK_FRAMES)]
    wrong, size = np.add.reduceat(wrong, edges, dtype=np.int64), np.diff(np.r_[edges, high - low])
    alike = wrong <= BIT_ERROR * FRAME_BITS * size
    frames = int(size[alike].sum())
    if frames < SHARE * len(one.bits):
        return None
    return offset, shared, float(wrong[alike].sum()) / (FRAME_BITS * frames)


def dealt(shared: DataFrame) -> tuple[DataFrame, int]:
    """(rec, bucket) for each rec of ``shared`` (rec, key, n: recordings that have the key), and the number of buckets.

    The bucket follows the most frequent key. Of a key that more than a bucket's share of recordings have, these are
    split by ``rec`` into as many parts as it needs.
    """
    homes = stored(shared.groupBy("rec").agg(F.max(F.struct("n", "key")).alias("home")), "homes")
    buckets = max(1, -(-homes.count() // BUCKET))
    part = F.pmod("rec", F.ceil(F.col("home.n") / F.lit(BUCKET)))
    return homes.select("rec", F.pmod(F.xxhash64("home.key", part), F.lit(buckets)).cast("int").alias("bucket")), buckets


def met_filter(recs: DataFrame) -> np.ndarray:
    """A filter (bytes of bits) of ``recs`` (rec). What reaches the driver has the filter's size at most."""
    places = F.array(*[F.shiftrightunsigned("rec", k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in FILTER_SHIFTS])
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    made = recs.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[made.column("place").to_numpy()] = made.column("bits").to_numpy()
    return out.view(np.uint8)


def _passes(bits: np.ndarray, recs: np.ndarray) -> np.ndarray:
    found = np.ones(len(recs), bool)
    for k in FILTER_SHIFTS:
        at = (recs.view(np.uint64) >> np.uint64(k)) & np.uint64(FILTER_BITS - 1)
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _once(recordings: DataFrame, met: np.ndarray) -> DataFrame:
    """A recording of each fingerprint for each task: copies, however many, are few rows after that.

    Recordings that ``met`` doesn't hold share none of the landmarks that queries are looked up by, and stay where they
    are, but for those that a full filter lets pass.
    """
    shared = recordings.sparkSession.sparkContext.broadcast(met)

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = []
            recs = batch.column("rec").to_numpy()
            for k in np.flatnonzero(_passes(shared.value, recs)).tolist():
                name = int(recs[k])
                if name not in seen:
                    seen.add(name)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return recordings.mapInArrow(work, recordings.schema)


def _runs(it: Recording) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, number) of landmarks of one key at places that follow one another, in the order of keys."""
    if not len(it.keys):
        return it.keys, it.ats, it.ats
    first = np.r_[0, np.flatnonzero((it.keys[1:] != it.keys[:-1]) | (it.ats[1:] != it.ats[:-1] + 1)) + 1]
    return it.keys[first], it.ats[first], np.diff(np.r_[first, len(it.keys)])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each of ``first`` on, one range after another."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _pieces(weights: np.ndarray):
    """Slices of ``weights`` that sum up to about ``PIECE`` at most, or have one element."""
    part = (np.cumsum(weights) - 1) // PIECE
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(weights)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which one of the columns differs from the place before, and the first one."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


class _Bucket:
    """The recordings of a bucket by their landmarks, and what queries have found of each."""

    def __init__(self):
        self.names: list[str] = []
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bits: list[np.ndarray] = []
        self.known: dict[str, int] = {}
        self.counts: dict[int, int] = {}
        self.best: dict[int, tuple] = {}
        self.ready = False

    def hold(self, name: str, it: Recording) -> None:
        if name not in self.known:
            self.known[name] = len(self.names)
            self.names.append(name)
            self.runs.append(_runs(it))
            self.bits.append(it.bits)

    def _prepare(self) -> None:
        """Runs by key and recording; for each key of a recording how many landmarks and runs it has."""
        keys, at, length = (np.concatenate(c) for c in zip((np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 2), *self.runs))
        owner = np.repeat(np.arange(len(self.runs)), np.array([len(r[0]) for r in self.runs], np.int64))
        order = np.argsort(keys, kind="stable")
        keys, owner, self.at, self.length = keys[order], owner[order], at[order], length[order]
        self.run = _changes(keys, owner)
        self.keys, self.owner = keys[self.run], owner[self.run]
        self.n_runs = np.diff(np.r_[self.run, len(keys)])
        self.n_marks = np.add.reduceat(self.length, self.run) if len(keys) else self.length
        self.frames = np.array([len(b) for b in self.bits], np.int64)
        self.runs, self.ready = [], True

    def ask(self, name: str, own: Recording) -> None:
        if not self.ready:
            self._prepare()
        need = max(1, ceil(VOTES * len(own.keys)))
        keys, at, length = _runs(own)
        of = _changes(keys)
        n_runs, n_marks = np.diff(np.r_[of, len(keys)]), np.add.reduceat(length, of) if len(keys) else length
        first, last = np.searchsorted(self.keys, keys[of], "left"), np.searchsorted(self.keys, keys[of], "right")
        entry, key = _ranges(first, last - first), np.repeat(np.arange(len(of)), last - first)
        # of a kind of landmark no more than the fewer of both can vote for one offset
        most = np.bincount(self.owner[entry], np.minimum(self.n_marks[entry], n_marks[key]), len(self.names))
        maybe = (most >= need) & (self.frames >= SHARE * len(own.bits))
        if name in self.known:
            maybe[self.known[name]] = False
        if not maybe.any():
            return
        kept = maybe[self.owner[entry]]
        entry, key = entry[kept], key[kept]
        order = np.argsort(self.owner[entry], kind="stable")
        entry, key = entry[order], key[order]
        who = np.flatnonzero(maybe)
        begin = np.searchsorted(self.owner[entry], np.r_[who, len(self.names)])
        sizes = len(own.bits) + self.frames[who] + 1
        for some in _pieces(sizes):
            part = slice(begin[some.start], begin[some.stop])
            start = np.cumsum(sizes[some]) - sizes[some]
            e, times = entry[part], self.n_runs[entry[part]]
            two, k = _ranges(self.run[e], times), np.repeat(key[part], times)
            to = np.repeat(start[np.searchsorted(who[some], self.owner[e])], times)
            corners = np.zeros(int(sizes[some].sum()), np.int64)
            for few in _pieces(n_runs[k]):
                times = n_runs[k[few]]
                one = _ranges(of[k[few]], times)
                m, n = length[one], np.repeat(self.length[two[few]], times)
                low = np.repeat(to[few] + len(own.bits) + self.at[two[few]], times) - at[one] - m
                corners += np.bincount(np.r_[low, low + m + n], minlength=len(corners))
                corners -= np.bincount(np.r_[low + np.minimum(m, n), low + np.maximum(m, n)], minlength=len(corners))
            votes = corners.cumsum().cumsum()  # a place late; each recording's corners sum up to 0, and so do their slopes
            best = np.maximum.reduceat(votes, start)
            hit = np.flatnonzero(votes >= np.repeat(np.maximum(best, need), sizes[some]))
            to = np.searchsorted(start, hit, "right") - 1
            offset = hit + 1 - start[to] - len(own.bits)
            order = np.lexsort((offset, np.abs(offset), to))
            order = order[_changes(to[order])]
            self._compare(name, own, who[some][to[order]], offset[order], best[to[order]])

    def _compare(self, name: str, own: Recording, who: np.ndarray, offset: np.ndarray, shared: np.ndarray) -> None:
        """Keep of these recordings those whose bits are alike at their offset."""
        low, high = np.maximum(0, -offset), np.minimum(len(own.bits), self.frames[who] - offset)
        long = high - low >= SHARE * len(own.bits)
        who, offset, shared, low, high = (c[long] for c in (who, offset, shared, low, high))
        for some in _pieces(high - low):
            size, place = (high - low)[some], _ranges(low[some], (high - low)[some])
            others = [self.bits[k][a:b] for k, a, b in zip(who[some].tolist(), (low + offset)[some].tolist(), (high + offset)[some].tolist())]
            wrong = np.bitwise_count(own.bits[place] ^ np.concatenate(others))
            to = np.repeat(np.arange(len(size)), size)
            edges = _changes(to, place // BLOCK_FRAMES)
            wrong, to, size = np.add.reduceat(wrong, edges, dtype=np.int64), to[edges], np.diff(np.r_[edges, len(place)])
            alike = wrong <= BIT_ERROR * FRAME_BITS * size
            frames = np.bincount(to[alike], size[alike], len(others)).astype(np.int64)
            errors = np.bincount(to[alike], wrong[alike], len(others))
            for k in np.flatnonzero(frames >= SHARE * len(own.bits)).tolist():
                it = int(who[some][k])
                self.counts[it] = self.counts.get(it, 0) + 1
                value = (-int(shared[some][k]), float(errors[k]) / (FRAME_BITS * int(frames[k])), name, int(offset[some][k]))
                self.best[it] = min(self.best.get(it, value), value)

    def batch(self) -> pa.RecordBatch:
        rows = [(self.names[k], n, *self.best[k]) for k, n in self.counts.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], ["sign", "n", "a", "b", "c", "d"])


def _aligned_in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """(sign, n, a, b, c, d) for each recording that queries of its bucket align with: their number, and the best of them.

    Rows of kind 0 are recordings, those of kind 1 queries. A task holds one bucket's recordings, and queries one at a time.
    """

    def work(batches):
        held, number = _Bucket(), None
        for batch in batches:
            for bucket, name, kind, bits in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sign", "kind", "bits"))):
                if bucket != number:
                    if held.counts:
                        yield held.batch()
                    held, number = _Bucket(), bucket
                if kind == 1:
                    held.ask(name, Recording.of(unpacked(bits)))
                elif name not in held.known:
                    held.hold(name, Recording.of(unpacked(bits)))
        if held.counts:
            yield held.batch()

    ordered = rows.select("bucket", "kind", "sign", "bits").repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind", "sign")
    return ordered.mapInArrow(work, "sign string, n long, a long, b double, c string, d long")


def align_recordings(recordings: DataFrame, is_query: Column, frames=word_frames, column: str = "text") -> DataFrame:
    """(doc_id, recording_id, n_queries, query_id, offset, shared, bit_error), a row for each row of ``recordings``.

    ``recordings`` has doc_id, the column and any others. Recordings of one fingerprint are one class, named by its
    smallest doc_id (null if none has one). ``is_query`` picks the rows whose classes are looked up among all classes.
    ``n_queries`` counts the other query classes that align with the row's class, ``query_id`` names the best of them:
    most shared landmarks, fewest bit errors, smallest sign. A recording of any length has a landmark, but for an empty
    one (null, or without frames), which aligns with nothing. Repeated rows are of one class; an empty table gives an
    empty table.
    """
    given = recordings.select("doc_id", F.coalesce(is_query, F.lit(False)).alias("asked"), column)
    marked = stored(fingerprint_recordings(given, frames, column), "recordings")
    rec = F.xxhash64("sign")  # short for the sign where rows are many; what it brings together is compared in full
    classes = stored(marked.groupBy("sign").agg(F.min("doc_id").alias("recording_id")), "classes")
    one = [F.first(c).alias(c) for c in ("keys", "bits")]
    own = stored(marked.where(F.col("asked") & (F.size("keys") > 0)).groupBy("sign").agg(*one), "own")
    wanted = own.select(F.explode("keys").alias("key")).distinct()
    # all landmarks move once, as two numbers each; only those that a query has go on
    landmarks_ = marked.select(rec.alias("rec"), F.explode(F.array_distinct("keys")).alias("key"))
    held = stored(landmarks_.join(wanted, "key", "left_semi").distinct(), "held")
    common = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    places = own.select("sign", F.size("keys").alias("size"), F.posexplode("keys").alias("place", "key")).join(common, "key")
    rank = F.row_number().over(Window.partitionBy("sign").orderBy("n", "key", "place"))
    rare = places.withColumn("rank", rank).where((F.col("rank") <= F.col("size") - needed(F.col("size")) + 1) & (F.col("n") > 1))
    rare = stored(rare.select("sign", "key", "n").distinct(), "rare")
    shared = stored(held.join(rare.select("key", "n").distinct(), "key"), "shared")
    home, buckets = dealt(shared)
    # a query goes to each bucket that holds one of its landmarks
    places = rare.join(shared.join(home, "rec").select("key", "bucket").distinct(), "key").select("sign", "bucket").distinct()
    asked = places.join(own, "sign").select("bucket", F.lit(1).alias("kind"), "sign", "bits")
    kept = _once(marked.select(rec.alias("rec"), "sign", "bits"), met_filter(home)).join(home, "rec")
    kept = kept.select("bucket", F.lit(0).alias("kind"), "sign", "bits")
    found = stored(_aligned_in_buckets(kept.unionByName(asked), buckets), "aligned")
    best = found.groupBy("sign").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "c", "d")).alias("best"))
    names = classes.select(F.col("sign").alias("query"), F.col("recording_id").alias("query_id"))
    best = best.withColumn("query", F.col("best.c")).join(names, "query").select(
        "sign", F.col("n").alias("n_queries"), "query_id", F.col("best.d").alias("offset"),
        (-F.col("best.a")).alias("shared"), F.col("best.b").alias("bit_error"),
    )
    named = classes.select("sign", "recording_id").join(best, "sign", "left")
    out = marked.select("doc_id", "sign").join(named, "sign")
    return out.select("doc_id", "recording_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), "query_id", "offset", "shared", "bit_error")
