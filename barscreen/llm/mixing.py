"""Mixing sources to target weights: which rows a mix takes, and how often.

Every row gets a hash-random key. Within a source rows are ordered by key; the mix takes whole epochs of the source
and then the rows up to the source's budget. Prefix sums of sizes are worked out in two levels: the high bits of the
key cut a source into ``RANGES`` ranges, whose sums are counted first, and rows are summed within a range. So no
source, however large, is ordered in one task, and texts needn't be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE

#: Ranges of keys in a source: a power of two.
RANGES = 4096
#: Weights of the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken this often at most.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null: ends of words are counted."""
    gap = f"[{WHITE} ]"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE} ](?={gap}|\\z)")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """``sources`` (nosource, source_key, source_size) with ``target``: the words that the mix takes of each.

    Sources in order get ``weights`` in turn, and share the sum of all sizes by weight. No target exceeds ``most``
    times its source's size; what is over is shared again by weight among the others. In the order of the ratio of
    that bound to the weight, the sources that reach their bound come first: their number follows from running sums.

    There is a row for each source here, so this orders the names of the sources, not the corpus.
    """
    order = Window.orderBy("nosource", "source_key")
    turn = (F.row_number().over(order) - 1) % len(weights)
    # the weights are parameters, a few literals
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    bound = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), "nosource", "source_key")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    placed = sources.withColumns({"weight": weight, "bound": bound}).withColumns({
        "bounds_before": F.coalesce(F.sum("bound").over(before), F.lit(0.0)),
        "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all_size": F.sum("source_size").over(every),
        "all_weight": F.sum("weight").over(every),
    })
    level = (F.col("all_size") - F.col("bounds_before")) / (F.col("all_weight") - F.col("weights_before"))
    reached = F.col("bound") <= level * F.col("weight")
    # the level of the first source that stays below its bound holds for all that follow; theirs would be lower
    placed = placed.withColumn("reached", reached).withColumn("level", F.max(F.when(~F.col("reached"), level)).over(every))
    target = F.when(F.col("reached"), F.col("bound")).otherwise(F.col("level") * F.col("weight"))
    return placed.withColumn("target", target).select("nosource", "source_key", "source_size", "target")


def mix_sources(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, ranges: int = RANGES,
    whole: bool = False, seed: int = 1
) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with size, source_size, target, taken and copies; given columns of
    these names give way.

    ``size`` counts the words of the text, ``taken`` those that the mix takes, repeats counted. ``copies`` says how
    often the row is used: whole epochs, and one more for a row up to the cut. The row at the cut is split, so that
    a source's taken words are its target rounded down; with ``whole`` it is taken if half of it or more fits.

    A null text has size 0 and, like any text without words, is taken for 0 words and has 0 copies, whatever its
    source. An empty table gives an empty table. A null source is a source of its own, the last in order. A source without words has target 0. Ties of the key are ordered by doc_id and size; rows
    equal in these are interchangeable. Reruns agree: the key hashes doc_id, text and ``seed``.
    """
    # given columns go by their places, so that none clashes with those that are made here
    place = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    doc_id, text, source = (F.col(place[c]) for c in ("doc_id", "text", "source"))
    key = F.xxhash64(F.lit(seed), doc_id, text)
    part = F.shiftrightunsigned(key, 64 - ranges.bit_length() + 1)
    rows = docs.toDF(*place.values()).withColumns({
        "size": word_count(text), "mix_key": key, "mix_range": part,
        "nosource": source.isNull().cast("int"), "source_key": F.coalesce(source.cast("string"), F.lit("")),
    })
    at = ["nosource", "source_key"]
    sums = rows.groupBy(*at, "mix_range").agg(F.sum("size").alias("range_size"))
    per_source = sums.groupBy(*at).agg(F.sum("range_size").alias("source_size"))
    aims = targets(per_source, weights, most)
    up_to = Window.partitionBy(*at).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)))
    starts = starts.join(aims, at).drop("range_size")

    # unsigned order within a range: the sign bit is part of the range
    inside = Window.partitionBy(*at, "mix_range").orderBy("mix_key", place["doc_id"], "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(starts, [*at, "mix_range"]).withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    size, budget = F.col("source_size"), F.floor("target")
    epochs = F.when(size > 0, F.floor(budget / size)).otherwise(F.lit(0))
    room = F.when(size > 0, budget - F.col("epochs") * size).otherwise(F.lit(0)) - F.col("start")
    part_taken = F.greatest(F.lit(0), F.least("size", F.col("room")))
    if whole:
        part_taken = F.when((2 * part_taken >= F.col("size")) & (part_taken > 0), F.col("size")).otherwise(F.lit(0))
    out = joined.withColumn("epochs", epochs).withColumn("room", room).withColumn("last", part_taken).withColumns({
        "taken": (F.col("epochs") * F.col("size") + F.col("last")).cast("long"),
        "copies": F.when(F.col("size") > 0, F.col("epochs") + (F.col("last") > 0).cast("int")).otherwise(0).cast("int"),
    })
    own = ("size", "source_size", "target", "taken", "copies")
    return out.select(*[F.col(p).alias(c) for c, p in place.items() if c.lower() not in own], *own)
