"""Exact top-k search by inner product over a pivot-distance index.

A vector gets one coordinate more, which makes all equally long: then a larger inner product is a smaller distance, and
the triangle inequality holds. A vector's key is its nearest pivot and the distance to it. Sorted by key, the rows are
cut into blocks, and a block into rings: stretches of one pivot, an annulus each. A query at distance d from a pivot is
at least as far from a ring of distances a to b as d is from that interval. A query searches the rings of a block in the
order of that bound, and stops where no ring can hold one of its k best any more. It searches its own block first, where
its neighbours by key are; then the other blocks, with the k-th best score that it has by then.

Blocks meet chunks of queries in tiles of bounded size, and only where a ring's interval meets one of the chunk's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Rows of a block and queries of a chunk at most: both are in a task's memory at once.
BLOCK_ROWS, CHUNK_QUERIES = 1 << 14, 1 << 13
#: Rows of a ring at most, and queries that are compared with it at once.
RING_ROWS, QUERY_ROWS = 512, 512
#: Pivots, and how many vectors they are chosen from: those with the least hashes of their components.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Parts into which the rows of one pivot are dealt when intervals are joined.
SALTS = 8
LONG = (-(1 << 63), (1 << 63) - 1)
#: The block of a query that is no row of any.
NOWHERE = -(1 << 40)


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null where the vector or one of its components is null or not finite.

    What exceeds the range of long is its end.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


@dataclass(frozen=True)
class Space:
    """What holds for all vectors: ``width`` components, none beyond ``most``, ``reach`` is the greatest squared length."""

    width: int
    most: int
    reach: float
    pivots: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Squared lengths, and the coordinate that makes them all ``reach``."""
        squares = np.einsum("ij,ij->i", x, x)
        return np.sqrt(np.maximum(self.reach - squares, 0.0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, pivots): distances of lifted vectors."""
        p, up, pivot_up = self.pivots, self.lifted(x), self.lifted(self.pivots)
        square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * x @ p.T
        return np.sqrt(np.maximum(square + (up[:, None] - pivot_up) ** 2, 0.0))

    def query_distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, pivots): distances of queries, whose further coordinate is 0, from lifted pivots."""
        square = np.einsum("ij,ij->i", x, x)[:, None] + self.reach - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (1.0 + np.sqrt(self.reach))

    def radius(self, squares: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance up to which a row may still have the score (the least long: any row may)."""
        far = self.reach + squares - 2 * np.where(score == LONG[0], -np.inf, score) + 2 + 1e-9 * self.reach
        return np.sqrt(np.maximum(far, 0.0)) + self.slack

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of int64 rows as int64; what exceeds the range of long is its end."""
        if self.width * self.most * self.most < 1 << 53:
            return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
        exact = queries.astype(object) @ rows.astype(object).T
        return np.clip(exact, *LONG).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def space(vectors: DataFrame, pivots: int) -> Space | None:
    """Of a table with ``vector`` (array of long, none null): a row of sums, and a bounded sample, reach the driver."""
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # abs of the least long is itself: half of it is compared
    most = F.array_max(F.transform("vector", lambda x: F.abs(F.shiftright(x, 1))))
    width, half, reach = vectors.agg(F.max(F.size("vector")), F.max(most), F.max(size)).first()
    if width is None:
        return None
    sample = vectors.select("vector", F.xxhash64("vector").alias("h")).distinct().orderBy("h").limit(PIVOT_SAMPLE)
    found = _matrix([r["vector"] for r in sample.collect()], width)
    exact = Space(width, 2 * ((half or 0) + 1), float(reach), found.astype(float))
    # the farthest from those chosen so far
    chosen = [0]
    gap = _apart(exact, exact.pivots, 0)
    while len(chosen) < min(pivots, len(found)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _apart(exact, exact.pivots, chosen[-1]))
    return Space(exact.width, exact.most, exact.reach, exact.pivots[chosen])


def _apart(at: Space, x: np.ndarray, k: int) -> np.ndarray:
    up = at.lifted(x)
    return np.sqrt(((x - x[k]) ** 2).sum(axis=1) + (up - up[k]) ** 2)


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _read(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows.astype("<i8")], pa.binary())


def keyed(vectors: DataFrame, at: Space) -> DataFrame:
    """(vec_id, wanted, vector: binary, pivot, distance) of ``vectors`` (vec_id, wanted, vector)."""

    def work(batches):
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, at.width) if (lengths == at.width).all() else _matrix(column.to_pylist(), at.width)
            d = at.distances(x.astype(float))
            near = d.argmin(axis=1)
            made = [_binary(x), pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("wanted"), *made], NAMES[:5])

    return vectors.select("vec_id", "wanted", "vector").mapInArrow(work, KEYED)


NAMES = ["vec_id", "wanted", "vector", "pivot", "distance", "block"]
KEYED = "vec_id long, wanted boolean, vector binary, pivot int, distance double"
FOUND = "query_id long, vec_id long, score long"


def cut(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """``rows`` in the order of their keys, with the number of a piece of ``size`` rows at most.

    Pieces follow ranges of the key, which ends with vec_id: equal vectors, however many, fill many pieces.
    """

    def work(batches):
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            piece = (first + (seen + np.arange(len(batch))) // size).astype(np.int64)
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], [*batch.schema.names, name])

    order = ["pivot", "distance", "vec_id"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    parts = max(1, -(-count // size))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(work, f"{kinds}, {name} long")


class Best:
    """The k best rows of some queries: score descending, then vec_id."""

    def __init__(self, ids: np.ndarray, k: int, known: np.ndarray):
        self.k, self.ids, self.known = k, ids, known
        self.scores = np.full((len(ids), k), LONG[0], np.int64)
        self.rows = np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros(len(ids), np.int64)

    def limit(self, at: np.ndarray) -> np.ndarray:
        """The k-th best score, from here or known before; the least long while there are fewer."""
        return np.maximum(self.known[at], np.where(self.filled[at] == self.k, self.scores[at, -1], LONG[0]))

    def add(self, at: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        """Rows with their scores by the queries at ``at``; only those that reach the limit count, never a query's own."""
        q, c = np.nonzero((scores >= self.limit(at)[:, None]) & (rows[None, :] != self.ids[at][:, None]))
        if not len(q):
            return
        touched = np.unique(at[q])
        old, place = np.nonzero(np.arange(self.k)[None, :] < self.filled[touched][:, None])
        who = np.r_[at[q], touched[old]]
        value = np.r_[scores[q, c], self.scores[touched[old], place]]
        name = np.r_[rows[c], self.rows[touched[old], place]]
        order = np.lexsort((name, ~value, who))  # ~x falls as x grows, also at the ends of long
        who, value, name = who[order], value[order], name[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        counts = np.diff(np.r_[first, len(who)])
        rank = np.arange(len(who)) - np.repeat(first, counts)
        top = rank < self.k
        self.scores[who[top], rank[top]] = value[top]
        self.rows[who[top], rank[top]] = name[top]
        self.filled[who[first]] = np.minimum(counts, self.k)

    def batch(self) -> pa.RecordBatch:
        has = np.arange(self.k)[None, :] < self.filled[:, None]
        ids = np.broadcast_to(self.ids[:, None], has.shape)
        return pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (ids, self.rows, self.scores)], ["query_id", "vec_id", "score"])


def search(at: Space, k: int, queries: np.ndarray, ids: np.ndarray, known: np.ndarray, rows: np.ndarray, row_ids, pivot, distance) -> Best:
    """The best of a block's rows, which are in the order of their keys; ``known`` is a k-th best score or the least long."""
    best = Best(ids, k, known)
    change = np.r_[True, pivot[1:] != pivot[:-1]]
    start = np.maximum.accumulate(np.where(change, np.arange(len(pivot)), 0))
    edges = np.flatnonzero((np.arange(len(pivot)) - start) % RING_ROWS == 0)
    ends = np.r_[edges[1:], len(pivot)]
    for begin in range(0, len(ids), QUERY_ROWS):
        some = np.arange(begin, min(begin + QUERY_ROWS, len(ids)))
        x = queries[some].astype(float)
        squares = np.einsum("ij,ij->i", x, x)
        d = at.query_distances(x)[:, pivot[edges]]
        low, high = distance[edges], distance[ends - 1]
        bound = np.maximum(np.maximum(d - high, low - d), 0.0) - at.slack  # (queries, rings)
        for ring in np.argsort(bound.mean(axis=0), kind="stable").tolist():
            open_ = some[bound[:, ring] <= at.radius(squares, best.limit(some))]
            if len(open_):
                part = slice(edges[ring], ends[ring])
                best.add(open_, at.products(queries[open_], rows[part]), row_ids[part])
    return best


def _own_blocks(blocks: DataFrame, at: Space, k: int) -> DataFrame:
    """The best rows of their own block for all queries."""

    def work(batches):
        for block in _groups(batches, ["block"]):
            wanted = np.flatnonzero(block.column("wanted").to_numpy(zero_copy_only=False))
            if not len(wanted):
                continue
            rows, ids = _read(block.column("vector"), at.width), block.column("vec_id").to_numpy()
            none = np.full(len(wanted), LONG[0])
            sides = [block.column(c).to_numpy() for c in ("pivot", "distance")]
            yield search(at, k, rows[wanted], ids[wanted], none, rows, ids, *sides).batch()

    return blocks.repartition("block").sortWithinPartitions("block", "pivot", "distance").mapInArrow(work, FOUND)


def _groups(batches, keys: list[str]):
    """Tables of the rows that agree in ``keys``, of batches sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(len(table), bool)
        for key in keys:
            x = table.column(key).to_numpy()
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(held) and held[-1].column(key)[-1].as_py() != x[0]
        cuts = np.r_[0, np.flatnonzero(new), len(table)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if new[a] and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _reaches(chunks: DataFrame, at: Space) -> DataFrame:
    """(chunk, pivot, low, high): the distances from each pivot within which rows may be among a chunk's best."""

    def work(batches):
        for batch in batches:
            x = _read(batch.column("vector"), at.width).astype(float)
            d = at.query_distances(x)
            r = at.radius(np.einsum("ij,ij->i", x, x), batch.column("known").to_numpy())[:, None] + at.slack
            chunk = batch.column("chunk").to_numpy()
            for c in np.unique(chunk):
                mine = chunk == c
                low, high = (d - r)[mine].min(axis=0), (d + r)[mine].max(axis=0)
                n = len(low)
                made = [np.full(n, c), np.arange(n, dtype=np.int32), low, high]
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], ["chunk", "pivot", "low", "high"])

    found = chunks.mapInArrow(work, "chunk long, pivot int, low double, high double")
    return found.groupBy("chunk", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _tiles(blocks: DataFrame, chunks: DataFrame, pairs: DataFrame, at: Space, k: int) -> DataFrame:
    """The best rows of other blocks than their own for the queries of each pair (chunk, block)."""
    data = pairs.join(blocks, "block").select("chunk", "block", F.lit(1).alias("kind"), "vec_id", "vector", "pivot", "distance",
                                              F.lit(0).cast("long").alias("known"), F.lit(NOWHERE).alias("home"))
    asked = pairs.join(chunks.withColumnRenamed("block", "home"), "chunk").select(
        "chunk", "block", F.lit(0).alias("kind"), "vec_id", "vector", "pivot", "distance", "known", "home")
    order = ["chunk", "block", "kind", "pivot", "distance"]

    def work(batches):
        for tile in _groups(batches, ["chunk", "block"]):
            rows, ids = _read(tile.column("vector"), at.width), tile.column("vec_id").to_numpy()
            pivot, distance, known, home, block = (tile.column(c).to_numpy() for c in ("pivot", "distance", "known", "home", "block"))
            kind = tile.column("kind").to_numpy()
            ask, has = np.flatnonzero((kind == 0) & (home != block)), np.flatnonzero(kind == 1)
            if len(ask) and len(has):
                yield search(at, k, rows[ask], ids[ask], known[ask], rows[has], ids[has], pivot[has], distance[has]).batch()

    return data.union(asked).repartition("chunk", "block").sortWithinPartitions(*order).mapInArrow(work, FOUND)


def top_k(
    vectors: DataFrame, wanted: Column, *, k: int = 20, pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the greatest inner product for each wanted row of ``vectors``.

    ``vectors`` has vec_id (long), vector (array of long, as ``quantised`` makes it) and any others, which are not read.
    Rows are ranked by score descending, then vec_id; a query's own id is no candidate of it, and fewer than k others are
    all returned. A shorter vector counts as filled up with zeros. Scores beyond the range of long are its end.

    A row without id or vector takes no part. Of a repeated id, the least vector (as Spark orders arrays) asks, and each
    row of another id is a candidate of its own. Equal vectors tie, however many there are. An empty table, or one
    without usable vectors, gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    given = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.coalesce(wanted, F.lit(False)).alias("wanted"))
    given = stored(given, "vectors")
    at = space(given, pivots)
    if at is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a repeated id asks once, from outside the blocks
    asking = given.where("wanted").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("vector").alias("vector"))
    again = stored(asking.where("n > 1").select("vec_id", F.lit(True).alias("wanted"), "vector"), "again")
    if not again.isEmpty():
        alone = F.col("wanted") & F.col("more").isNull()
        more = again.select("vec_id", F.lit(True).alias("more"))
        given = given.join(more, "vec_id", "left").select("vec_id", "vector", alone.alias("wanted"))
    rows = stored(keyed(given, at), "keyed")
    blocks = stored(cut(rows, rows.count(), block_rows, "block"), "blocks")
    near = stored(_own_blocks(blocks, at, k), "near")
    bound = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    known = F.coalesce(F.when(F.col("n") >= k, F.col("least")), F.lit(LONG[0])).alias("known")
    queries = blocks.where("wanted").union(keyed(again, at).withColumn("block", F.lit(NOWHERE)))
    asked = queries.join(bound, F.col("vec_id") == F.col("query_id"), "left").select(*NAMES, known)
    chunks = stored(cut(asked, asking.count(), chunk_queries, "chunk"), "chunks")
    rings = blocks.groupBy("block", "pivot").agg(F.min("distance").alias("first"), F.max("distance").alias("last"))
    rings = rings.withColumn("salt", F.pmod("block", F.lit(SALTS)))
    reach = _reaches(chunks, at).withColumn("salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(SALTS)])))
    meets = (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))
    pairs = stored(rings.join(reach, ["pivot", "salt"]).where(meets).select("chunk", "block").distinct(), "pairs")
    every = near.union(_tiles(blocks, chunks, pairs, at, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
