"""Which texts of groups of candidates are alike by their sets of shingles, without a pair of texts ever being a row.

A group is dealt to chunks of bounded size. A tile has the sets of two chunks, each once; inside it, common shingles of all
pairs are counted at once by products of incidence matrices, and a few links are given that connect whatever all
links of the tile connect. First each chunk meets itself and the next one, which connects most groups wholly.
Of a group that isn't, the members outside of its largest part then meet all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Texts, and shingles of them, that a chunk has about: two chunks are in a task's memory at once.
CHUNK_TEXTS, CHUNK_SHINGLES = 256, 1 << 19
#: Columns of an incidence matrix at a time.
MATRIX_COLUMNS = 1 << 12
#: Up to so many texts, pairs are compared one by one.
FEW = 8
SETS = "node long, size int, shingles binary"


def alike(least: int, most: int, common: int, similarity: float) -> bool:
    return common >= similarity * (least + most - common) - 1e-9


def tile_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of the similarity that connect whatever all such pairs connect; rows of one label, or node, are connected."""
    _, parent = np.unique(labels, return_index=True)
    first = dict(zip(np.unique(labels).tolist(), parent.tolist()))
    root = [first[x] for x in labels.tolist()]
    found: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((i, j))

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(nodes) <= FEW:
        for i in range(len(nodes)):
            for j in range(i):
                least, most = sorted((int(sizes[i]), int(sizes[j])))
                if top(i) != top(j) and least >= similarity * most - 1e-9:
                    if alike(least, most, len(np.intersect1d(sets[i], sets[j], assume_unique=True)), similarity):
                        link(j, i)
        return found
    common = common_counts(sets)
    every = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(common >= similarity * every - 1e-9, 1))
    for a, b in zip(i.tolist(), j.tolist()):
        link(a, b)
    return found


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, rows): how many shingles each two sets have in common."""
    n = len(sets)
    out = np.zeros((n, n))
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(values) else new
    out[np.diag_indices(n)] = [len(s) for s in sets]
    owner, number = owner[shared], number[shared]
    if not len(owner):
        return out
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1
    counts = np.zeros((n, n), np.float32)
    for a in range(0, int(number[-1]) + 1, MATRIX_COLUMNS):
        low, high = np.searchsorted(number, (a, a + MATRIX_COLUMNS))
        incidence = np.zeros((n, MATRIX_COLUMNS), np.float32)
        incidence[owner[low:high], number[low:high] - a] = 1
        counts += incidence @ incidence.T
    apart = ~np.eye(n, dtype=bool)
    out[apart] = counts[apart]
    return out


def _tiles(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links inside each tile of ``rows`` (root, a, b, node, label, shingles)."""

    def work(batches):
        held: list[pa.Table] = []

        def links():
            tile = pa.concat_tables(held)
            nodes, at = np.unique(tile.column("node").to_numpy(), return_index=True)
            shingles = tile.column("shingles")
            sets = [np.frombuffer(shingles[k].as_py(), "<u8") for k in at.tolist()]
            pairs = tile_links(nodes, tile.column("label").to_numpy()[at], sets, similarity)
            ends = [np.array([p[k] for p in pairs], np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(nodes[e]) for e in ends], ["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(c).to_numpy() for c in ("root", "a", "b")]
            new = np.zeros(len(batch), bool)
            for key, name in zip(keys, ("root", "a", "b")):
                new[1:] |= key[1:] != key[:-1]
                new[0] |= bool(held) and held[-1].column(name)[-1].as_py() != key[0]
            cuts = np.r_[0, np.flatnonzero(new), len(batch)].tolist()
            for x, y in zip(cuts[:-1], cuts[1:]):
                if new[x] and held:
                    yield links()
                    held.clear()
                if y > x:
                    held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
        if held:
            yield links()

    keys = ["root", "a", "b"]
    ordered = rows.select(*keys, "node", "label", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(work, "u long, v long")


def _parts(texts, shingles):
    return F.greatest(F.ceil(texts / CHUNK_TEXTS), F.ceil(shingles / CHUNK_SHINGLES), F.lit(1)).cast("int")


def links_within(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of the similarity that connect whatever all such links inside of groups connect.

    ``groups`` has node and root, ``sets`` node, size and shingles (sorted distinct unsigned longs, little-endian).
    """
    members = stored(groups.join(sets.select("node", "size"), "node"), "members")
    sums = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    sums = sums.where("n > 1").select("root", _parts(F.col("n"), F.col("m")).alias("parts"))
    chunk = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = members.join(sums, "root").withColumn("c", chunk)
    after = F.pmod(F.col("c") + 1, F.col("parts")).cast("int")
    mine = F.when(F.col("parts") > 1, F.array("c", after)).otherwise(F.array("c"))
    tiles = placed.select("root", F.explode(mine).alias("a"), F.lit(0).alias("b"), "node", F.col("node").alias("label"))
    good = stored(_tiles(tiles.join(sets.select("node", "shingles"), "node"), similarity), "good")

    # groups of so many chunks that some haven't met, and that aren't connected yet
    wide = placed.where("parts > 2").select("root", "parts", "node")
    if wide.isEmpty():
        return good
    labels = components(good).select("node", F.col("root").alias("label")).distinct()
    wide = stored(wide.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "wide")
    counts = wide.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("root").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    split = largest.where(F.col("most.n") < F.col("all"))
    split = split.select("root", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / CHUNK_TEXTS).cast("int").alias("outside"))
    left = wide.join(split, "root").withColumns({
        "a": F.pmod(F.xxhash64("node"), F.col("outside")).cast("int"), "b": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = left.select("root", each("outside").alias("a"), "b", "node", "label")
    outside = left.where("label <> main").select("root", "a", each("parts").alias("b"), "node", "label")
    met = others.union(outside).distinct()
    return good.union(_tiles(met.join(sets.select("node", "shingles"), "node"), similarity))
