"""Phrases of two and three words that score best in their language, by best-first growth with bounds.

Words and pairs are counted over the whole corpus. A pair is the prefix of the triples that grow from it, and the counts
bound their scores: a triple x y z occurs at most as often as x y and y z, so cut after its first word it scores
f(x y) / f(x) at most, and cut before its last word f(y z) / f(z) at most. From the best scores on, the frontier is
widened until each language's last place is settled: in a round only those triples are counted whose both bounds reach
the round's threshold, and those that may cover a pair which itself reaches it. All that score the threshold or more are
known then, ties included; where too few of them survive, the next round has a lower threshold.

Tasks learn the frontier as three filters of hashed pairs of a fixed size. A filter that lets more pass than it should
costs counting, not correctness: whatever is counted is counted in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, UPPER, small_batches, stored

#: Words that a task counts before it passes their counts on.
BLOCK_WORDS = 1 << 20
#: Counts that go from a task's Python to Spark at a time.
BATCH_ROWS = 1 << 14
#: Bits of each filter (a power of two) and hashes of a pair: 4 MB, whatever the corpus.
FILTER_BITS, FILTER_HASHES = 1 << 25, 3
#: Parts into which the pairs of one word are dealt where its count is joined.
SALTS = 16
#: The first threshold is reached by so many times as many pairs as are wanted, and each next one by so many times more.
FRONTIER, STEPS = 4, 100
#: Scores are floored after this factor.
SCALE = 1_000_000
#: Ends of pieces; no UTF-8 text has the byte that stands for them.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
PLAIN = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, LOWER.encode() + b" " + MARK * len(ENDS))
COUNTED = "lang string, w1 string, w2 string, w3 string, n long"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _blocks(batches, text: str):
    """(lang, words, numbers): distinct words of a block of texts of one language, and its words by number; 0 ends a piece."""
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    size = 0

    def blocks():
        for lang, (numbers, ids) in held.items():
            yield lang, list(numbers), np.concatenate(ids)

    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column(text).cast(pa.binary()).to_pylist()):
            words = (raw or b"").translate(PLAIN).replace(MARK, b" \xff ").split()
            words.append(MARK)
            if lang not in held:
                held[lang] = _Numbers({MARK: 0}), [np.zeros(1, np.int32)]
            numbers, ids = held[lang]
            ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield from blocks()
                held.clear()
                size = 0
    yield from blocks()


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _counted(lang: str, words: list[bytes], parts: list[np.ndarray], counts: np.ndarray):
    """Phrases by the numbers of their words, with counts, in batches."""
    names = pa.array([b"" if w == MARK else w for w in words], pa.binary()).cast(pa.string())
    for a in range(0, len(counts), BATCH_ROWS):
        n = pa.array(counts[a : a + BATCH_ROWS], pa.int64())
        columns = [names.take(pa.array(p[a : a + BATCH_ROWS])) for p in parts] + [pa.nulls(len(n), pa.string())] * (3 - len(parts))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *columns, n], ["lang", "w1", "w2", "w3", "n"])


def small_phrases(texts: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, n): counts of all words and pairs of ``texts`` (lang, text), pairs of one piece only."""

    def work(batches):
        for lang, words, ids in _blocks(batches, "text"):
            n = np.bincount(ids, minlength=len(words))
            n[0] = 0
            some = np.flatnonzero(n)
            yield from _counted(lang, words, [some], n[some])
            inside = (ids[1:] > 0) & (ids[:-1] > 0)
            keys, n = _sums((ids[:-1].astype(np.int64) * len(words) + ids[1:])[inside])
            yield from _counted(lang, words, [keys // len(words), keys % len(words)], n)

    return texts.mapInArrow(work, COUNTED).groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair_hashes(lang: np.ndarray | np.uint64, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(lang + np.uint64(0x9E3779B97F4A7C15) * first) + second)


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """The places of a filter that belong to each hash."""
    step = _mixed(hashes) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for k in range(FILTER_HASHES)]


def _word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A filter (bytes of bits) of ``pairs`` (lang, w1, w2). What reaches the driver has the filter's size at most."""

    def work(batches):
        found = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            lang, first, second = (_word_hashes([x.encode() for x in batch.column(c).to_pylist()]) for c in ("lang", "w1", "w2"))
            for at in _bits(_pair_hashes(lang, first, second)):
                np.bitwise_or.at(found, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        place = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(found[place].view(np.int64))], ["place", "bits"])

    parts = pairs.select("lang", "w1", "w2").mapInArrow(work, "place long, bits long")
    made = parts.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[made.column("place").to_numpy()] = made.column("bits").to_numpy()
    return out.view(np.uint8)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _bits(hashes):
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def grown_phrases(texts: DataFrame, filters: list, before: list | None) -> DataFrame:
    """(lang, w1, w2, w3, n): counts of the triples that the round's filters let pass and an earlier round's didn't.

    ``filters`` are broadcast: of prefixes and suffixes that reach the threshold by their bounds, and of pairs that do so by their score.
    """

    def work(batches):
        for lang, words, ids in _blocks(batches, "text"):
            ids, v, hashes = ids.astype(np.int64), len(words), _word_hashes(words)
            inside = np.flatnonzero((ids[2:] > 0) & (ids[1:-1] > 0) & (ids[:-2] > 0))
            if not len(inside):
                continue
            pairs, place = np.unique(np.r_[ids[inside] * v + ids[inside + 1], ids[inside + 1] * v + ids[inside + 2]], return_inverse=True)
            one, two = place[: len(inside)], place[len(inside) :]
            known = _pair_hashes(np.uint64(xxh64_intdigest(lang)), hashes[pairs // v], hashes[pairs % v])
            wanted = np.ones(len(inside), bool)
            for group, keep in ((filters, True), (before, False)):
                if group is not None:
                    prefix, suffix, scored = (_holds(f.value, known) for f in group)
                    wanted &= ((prefix[one] & suffix[two]) | scored[one] | scored[two]) == keep
            at = inside[wanted]
            keys, n = _sums(one[wanted] * v + ids[at + 2])
            yield from _counted(lang, words, [pairs[keys // v] // v, pairs[keys // v] % v, keys % v], n)

    return texts.mapInArrow(work, COUNTED).groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("a"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly: the products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right)).cast("long")


def _share(a: Column, whole: Column) -> Column:
    """The bound of a phrase that occurs ``a`` times, cut beside a part that occurs ``whole`` times."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(whole)).cast("long")


def _thresholds(pairs: DataFrame, langs: DataFrame, enough: int) -> DataFrame:
    """(lang, least): a score that ``enough`` pairs of the language reach, or 0 where it has fewer.

    Any threshold serves, so scores are counted by ``STEPS`` steps of their root: few rows a language, however many pairs.
    """
    width = int(SCALE**0.5) // STEPS
    counts = pairs.groupBy("lang", F.floor(F.sqrt("s") / width).alias("step")).agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("sum", F.sum("c").over(up_to)).where(F.col("sum") >= enough)
    highest = reached.groupBy("lang").agg((F.max("step") * F.max("step") * width * width).alias("high"))
    return langs.join(highest, "lang", "left").select("lang", F.coalesce("high", F.lit(0)).cast("long").alias("least"))


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs`` (lang, w1, w2, a) with the counts n1 and n2 of their words (lang, w, n), their score s, and as bounds of
    triples ``before`` (the pair as prefix) and ``after`` (as suffix). The pairs of a frequent word are dealt to ``SALTS`` parts."""
    dealt = words.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    both = pairs
    for one, two, n in (("w1", "w2", "n1"), ("w2", "w1", "n2")):
        both = both.withColumn("salt", F.pmod(F.xxhash64(two), F.lit(SALTS)))
        both = both.join(dealt.select("lang", F.col("w").alias(one), "salt", F.col("n").alias(n)), ["lang", one, "salt"]).drop("salt")
    a = F.col("a")
    return both.withColumns({"s": score(a, F.col("n1"), F.col("n2")), "before": _share(a, F.col("n1")), "after": _share(a, F.col("n2"))})


def _scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """``triples`` (lang, w1, w2, w3, a) with the counts of the cut that scores least, the shorter first part where both tie."""
    starts = pairs.select("lang", "w1", "w2", F.col("a").alias("start"), F.col("n1").alias("first"))
    ends = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("rest"), F.col("n2").alias("last"))
    both = triples.join(starts, ["lang", "w1", "w2"]).join(ends, ["lang", "w2", "w3"])
    both = both.withColumns({"s1": score(F.col("a"), F.col("first"), F.col("rest")), "s2": score(F.col("a"), F.col("start"), F.col("last"))})
    early = F.col("s1") <= F.col("s2")
    cut = [F.when(early, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("l", "first", "start"), ("r", "rest", "last"), ("s", "s1", "s2"))]
    return both.select("lang", "w1", "w2", "w3", "a", *cut)


def _first(phrases: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The first ``top`` rows of each of ``keys``, with their rank. Parts of a language first: a language may have many ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc("s"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _survivors(pairs: DataFrame, triples: DataFrame, limits: DataFrame, cover: int) -> DataFrame:
    """(lang, phrase, a, l, r, s): ``pairs`` that no triple covers, and the ``triples`` that reach their language's limit."""
    parts = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
    covers = parts.groupBy("lang", "w1", "w2").agg(F.max("a").alias("most"))
    free = F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))
    left = pairs.join(covers, ["lang", "w1", "w2"], "left").where(free)
    left = left.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), "s")
    high = triples.join(limits, "lang").where(F.col("s") >= F.col("least"))
    return left.union(high.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "s"))


def mine_collocations(docs: DataFrame, *, least: int = 10, top: int = 2000, cover: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of ``docs`` (lang, text, any others).

    A-Z is lower-cased; texts end pieces at ``.,;:!?`` and line ends, and spaces and tabs separate words. A candidate has two
    or three words and occurs ``least`` times (a) in pieces; cut after some words, its parts occur l and r times, and it
    scores floor(1000000 a a / (l r)) at its worst cut. A pair is dropped if a triple that holds it is a candidate with
    ``cover`` per cent of its occurrences or more. Order: score, then a, both descending, then the phrase's bytes.

    A null text is empty; a null language is ``und``. Repeated rows count each time. A language with fewer
    phrases returns all of them, one without any no row, and an empty table gives an empty result. Counts may have 16 digits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    # words of any count, for n; rarer pairs can't be part of a candidate
    counts = stored(small_phrases(texts).where(F.col("w2").isNull() | (F.col("n") >= least)), "phrases")
    words = counts.where("w2 is null").select("lang", F.col("w1").alias("w"), "n")
    sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    pairs = stored(_scored_pairs(counts.where("w2 is not null").select("lang", "w1", "w2", F.col("n").alias("a")), words.where(F.col("n") >= least)), "pairs")

    langs = sizes.select("lang")
    limits = stored(_thresholds(pairs, langs, FRONTIER * top), "limits")
    filters = grown = None
    enough = FRONTIER * top
    while True:
        within = [pairs.join(limits, "lang").where(F.col(bound) >= F.col("least")) for bound in ("before", "after", "s")]
        before, filters = filters, [spark.sparkContext.broadcast(pair_filter(p)) for p in within]
        more = grown_phrases(texts, filters, before).where(F.col("a") >= least)
        more = stored(_scored_triples(more, pairs), "triples")
        grown = more if grown is None else grown.union(more)
        best = stored(_survivors(within[2], grown, limits, cover), "best")
        have = best.groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
        unsettled = limits.join(have, "lang", "left").where((F.col("least") > 0) & (F.coalesce("have", F.lit(0)) < top))
        unsettled = stored(unsettled.select("lang", F.lit(True).alias("lower")), "unsettled")
        if unsettled.isEmpty():
            break
        enough *= FRONTIER
        lower = _thresholds(pairs, langs, enough).withColumnRenamed("least", "next").join(unsettled, "lang", "left")
        limits = limits.join(lower, "lang").select("lang", F.when(F.col("lower"), F.col("next")).otherwise(F.col("least")).alias("least"))
        limits = stored(limits, "limits")
    first = _first(_first(best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), ["lang", "part"], top), ["lang"], top)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("s").alias("score"))
