"""SimHash near-duplicates, compared in bit-sliced blocks.

A fingerprint has a bit for each bit of the shingles' hashes: 1 if more than half of them have it set. Two texts
are linked if their fingerprints differ in at most ``radius`` bits, and components of links are classes of copies.

Candidates share a key. ``pigeonhole`` keys find every link of a 64-bit fingerprint within three bits: of five
blocks of bits, two at least are equal. ``bands`` of a wide fingerprint find the links of a wider radius with a
probability that grows with the number of bands. Inside a bucket the rows are compared by ``bitslice.links``.

With a ``similarity``, links of fingerprints are candidates only: the texts' sets of shingles are compared, and a link
holds from that similarity on (common shingles by all shingles of the two). Keys are then bands of least hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .alike import SETS, links_within
from .bitslice import links
from .common import small_batches, stored
from .components import components

SEED = 42
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of chunks of so many rows.
BUCKET_ROWS = 50_000
#: Fingerprints that a task compares at once.
BLOCK_ROWS = 1 << 15
PIGEONHOLE_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


@dataclass(frozen=True)
class SimHash:
    """``bits`` is 64 (all links within ``radius`` <= 3 are found) or a larger multiple of 64 (bands of 16 bits)."""

    shingle: int = 3
    bits: int = 64
    radius: int = 3
    similarity: float | None = None

    def __post_init__(self) -> None:
        if self.bits % 64 or self.bits < 64 or (self.bits == 64 and self.radius > 3):
            raise ValueError("64 bits serve a radius of 3 at most; wider fingerprints have a multiple of 64 bits")


#: For stages on five-word shingles and a similarity of 0.8. Such texts differ in 78 of 512 bits on average, with a
#: deviation of 8, and texts of a few shingles in up to 96; unrelated ones differ in 256.
NEAR = SimHash(shingle=5, bits=512, radius=120, similarity=0.8)
#: Bands of least hashes, and hashes of a band: texts of a similarity of 0.8 share a band with a probability of 0.998.
MIN_BANDS, MIN_ROWS = 16, 5


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 of each run of ``size`` lower-cased words; a shorter text is one run, a text without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th further 64 bits of a hash (the finaliser of splitmix64)."""
    if not k:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majorities(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """(texts, words) of uint64 from all texts' hashes, one text after another, and how many each has."""
    out = np.zeros((len(counts), words), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    # byte counters hold 255 at most: texts are summed in runs of 255 hashes
    runs = -(-n // 255)
    place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts, texts = np.repeat(first, runs) + 255 * place, np.cumsum(runs) - runs
    every = np.uint64(0x0101010101010101)
    for k in range(words):
        h = _mixed(hashes, k)
        value = np.zeros(len(full), np.uint64)
        for s in range(8):
            run = np.add.reduceat((h >> np.uint64(s)) & every, cuts)
            total = np.add.reduceat(run.view(np.uint8).reshape(-1, 8).astype(np.int64), texts, axis=0)
            for byte in range(8):
                value |= (2 * total[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + s)
        out[full, k] = value
    return out


def least_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, MIN_BANDS) of uint64: a key for each band of least hashes; texts without shingles have zeros."""
    out = np.zeros((len(counts), MIN_BANDS), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = np.cumsum(counts[full]) - counts[full]
    odd = _mixed(np.arange(2 * MIN_BANDS * MIN_ROWS, dtype=np.uint64), 1)
    for band in range(MIN_BANDS):
        key = np.full(len(full), band, np.uint64)
        for k in range(band * MIN_ROWS, (band + 1) * MIN_ROWS):
            key = _mixed(key ^ np.minimum.reduceat((hashes ^ odd[2 * k]) * (odd[2 * k + 1] | np.uint64(1)), first), 1)
        out[full, band] = key
    return out


def _nodes(fps: np.ndarray) -> np.ndarray:
    """A long for each fingerprint: itself, or the hash of a wider one."""
    if fps.shape[1] == 1:
        return fps[:, 0].view(np.int64)
    raw = fps.astype(">u8")
    return np.fromiter((xxh64_intdigest(x.tobytes(), SEED) for x in raw), np.uint64, len(raw)).view(np.int64)


def _names(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)


def _binary(fps: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in fps.astype(">u8")], pa.binary())


def _words(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def fingerprints(docs: DataFrame, how: SimHash, text: str = "text") -> DataFrame:
    """``docs`` with ``fp`` (binary) and ``node`` (long) in place of the text.

    With a similarity a shingle counts once, its keys follow the fingerprint, and ``node`` names the set of shingles.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    words = how.bits // 64

    def work(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            found = []
            for x in texts:  # one text at a time: only hashes stay
                hashes = np.array(shingle_hashes(x.as_py(), how.shingle), np.uint64)
                found.append(hashes if how.similarity is None else np.unique(hashes))
            fps = np.zeros((len(found), words if how.similarity is None else words + MIN_BANDS), np.uint64)
            at = 0
            while at < len(found):  # so many hashes at once
                to, size = at, 0
                while to < len(found) and (to == at or size + len(found[to]) <= 1 << 19):
                    size += len(found[to])
                    to += 1
                counts = np.array([len(x) for x in found[at:to]], np.int64)
                hashes = np.concatenate(found[at:to])
                fps[at:to, :words] = majorities(hashes, counts, words)
                if how.similarity is not None:
                    fps[at:to, words:] = least_hashes(hashes, counts)
                at = to
            nodes = _nodes(fps) if how.similarity is None else _names(found)
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, _binary(fps), pa.array(nodes)], [*rest, "fp", "node"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.select(*rest, text).mapInArrow(work, f"{kinds}, fp binary, node long")


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """(rows, keys): the number of the key in the high half, its bits in the low half."""
    if fps.shape[1] == 1:
        h = fps[:, 0]
        part = [(h >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in PIGEONHOLE_BLOCKS]
        keys = [part[a] << np.uint64(13) | part[b] for a, b in combinations(range(5), 2)]
    else:
        keys = [fps[:, k // 4] >> np.uint64(16 * (k % 4)) & np.uint64(0xFFFF) for k in range(4 * fps.shape[1])]
    return np.stack([k | np.uint64(i << 32) for i, k in enumerate(keys)], axis=1).view(np.int64)


def fingerprint_links(nodes: DataFrame, how: SimHash, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links between the distinct fingerprints of ``nodes`` (fp) that connect whatever all links connect.

    With a similarity ``nodes`` has node as well, and keys follow the fingerprint.
    """
    words = how.bits // 64
    named = [] if how.similarity is None else ["node"]

    def keyed(batches):
        for batch in batches:
            if named:
                wide = _words(batch.column("fp"), words + MIN_BANDS)
                fps, keys = _binary(wide[:, :words]), wide[:, words:].view(np.int64)
            else:
                fps, keys = batch.column("fp"), bucket_keys(_words(batch.column("fp"), words))
            again = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            columns = [pa.array(keys.ravel()), *(batch.column(c).take(again) for c in named), fps.take(again)]
            yield pa.RecordBatch.from_arrays(columns, ["k", *named, "fp"])

    def compared(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= BLOCK_ROWS:
                rows = pa.concat_tables(held)
                ids = _bucket_ids(rows)
                cut = int(np.searchsorted(ids, ids[-1]))  # the last bucket may go on
                if cut:
                    yield from _found(rows.slice(0, cut), ids[:cut])
                held = [rows.slice(cut)]
        if held:
            rows = pa.concat_tables(held)
            yield from _found(rows, _bucket_ids(rows))

    def _bucket_ids(rows):
        change = np.zeros(len(rows), bool)
        for c in ("k", "a", "b"):
            x = rows.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.cumsum(change)

    def _found(rows, ids):
        fps = _words(rows.column("fp"), words)
        pairs = links(ids, fps, how.radius)
        if pairs:
            ends = [[p[i] for p in pairs] for i in (0, 1)]
            u, v = (rows.column("node").to_numpy()[x] if named else _nodes(fps[x]) for x in ends)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = nodes.select(*named, "fp").mapInArrow(keyed, ", ".join(["k long", *(f"{c} long" for c in named), "fp binary"]))
    large = stored(rows.groupBy("k").count().where(F.col("count") > bucket_rows), "large")  # few: Spark broadcasts it while it is small
    parts = F.coalesce(F.ceil(F.col("count") / bucket_rows), F.lit(1)).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        rows.join(large, "k", "left").withColumn("parts", parts).withColumn("c", chunk)
        .select("k", "c", *named, "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
        .select("k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), *named, "fp")
    )
    order = F.xxhash64("node") if named else F.col("fp")
    return dealt.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b", order).mapInArrow(compared, "u long, v long")


def _row_sign():
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def shingle_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, how: SimHash) -> DataFrame:
    """(node, size, shingles) for each of ``wanted`` (node), from the text of one row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(x.as_py(), how.shingle), "<u8")) for x in batch.column("text").cast(pa.binary())]
            sizes = pa.array(list(map(len, sets)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "size", "shingles"])

    one = marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row_sign").alias("row_sign"))
    texts = docs.select(_row_sign().alias("row_sign"), "text").join(one, "row_sign").select("node", "text")
    # equal rows agree in their sign, and in their sets
    return texts.mapInArrow(work, SETS).groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))


def similar_links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, how: SimHash) -> DataFrame:
    """(u, v): links of ``nodes`` of the similarity that connect whatever all such links in a group of candidates connect.

    Few links of fingerprints connect all candidates to groups; inside of a group sets of shingles are compared.
    ``marked`` has node and row_sign, ``docs`` the texts.
    """
    groups = stored(components(fingerprint_links(nodes, how)), "groups")
    sets = stored(shingle_sets(docs, marked, groups.select("node"), how), "sets")
    return links_within(groups, sets, how.similarity)


def simhash_classes(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(the columns of ``docs`` but the text, fp, node, root, component_id), a row for each row of ``docs``.

    ``docs`` has doc_id, text and any others; those of the names above, row_sign or n give way. component_id is the smallest doc_id that links reach,
    null where all of them are null. Texts without words (null, empty, white space) have a fingerprint of zeros,
    which links like any other (with a similarity they are copies of each other only). Rows of one root are one class. Repeated rows share a fingerprint. An empty table gives an empty table.
    """
    own = ("fp", "node", "root", "component_id", "row_sign", "n")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in own])
    given = docs if how.similarity is None else docs.withColumn("row_sign", _row_sign())
    marked = stored(fingerprints(given, how), "fingerprints")
    nodes = stored(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("rep")), "nodes")
    stars = components(fingerprint_links(nodes, how) if how.similarity is None else similar_links(docs, marked, nodes, how))
    grouped = stars.join(nodes.select("node", "rep"), "node")
    least = grouped.groupBy("root").agg(F.min("rep").alias("least"))
    joined = stars.join(least, "root").select("node", "root", "least")
    classes = nodes.join(joined, "node", "left").select(
        F.col("node").alias("n"),
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"),
    )
    return marked.join(classes, F.col("node") == F.col("n")).drop("n", "row_sign")


def survivors(docs: DataFrame, how: SimHash = NEAR) -> DataFrame:
    """One row of ``docs`` (doc_id, text, any others) for each class: that of the smallest doc_id, nulls last.

    Rows that agree in doc_id and text count as one; of such rows any may stay.
    """
    sign = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keys = simhash_classes(docs.select("doc_id", sign.alias("sign"), "text"), how)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("sign").alias("sign"))
    chosen = keys.groupBy("root").agg(F.min(order).alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias("chosen_id"), F.col("first.sign").alias("chosen_sign"))
    row = F.struct(*docs.columns)
    once = docs.select(F.col("doc_id").alias("own_id"), sign.alias("own_sign"), row.alias("row")).dropDuplicates(["own_id", "own_sign"])
    same = F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_sign") == F.col("chosen_sign"))
    return once.join(chosen, same, "left_semi").select("row.*")
