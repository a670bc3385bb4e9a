"""Quality rules: countable rules, then a hashed n-gram log-likelihood ratio of trusted texts against the corpus.

Two multinomials over ``buckets`` hash buckets of word 1- and 2-grams, case kept, are counted: one over the whole corpus,
one over trusted texts. The weight of a bucket is the logarithm of the ratio of its two probabilities, both
smoothed by ``pseudo`` counts spread as the corpus spreads them, so that a bucket too rare to judge weighs
nothing. A text scores the mean weight of its n-grams; texts below ``threshold`` are rejected.

Everything is a built-in expression. The counts leave a task as one row per bucket; the model is one array of
``buckets`` doubles, whatever the size of the corpus, and reaches the scoring scan as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, without, words

SYMBOLS = "#*$%&|<>"
#: A power of two.
BUCKETS = 1 << 16
PSEUDO = 5.0
THRESHOLD = -0.1
#: At most so many trusted texts are learnt from: those of the smallest hashes of their ids.
TRUSTED_ROWS = 20_000
WINDOW = 8


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """Ids that no row of ``labels`` marks as bad and some row marks as good, ``limit`` of them at most.

    Rows without an id or a mark are passed over; a toxic text isn't trusted.
    """
    good = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("worst"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("worst = 1 and toxic = 0")
    )
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def gram_hashes(once: Column) -> Column:
    """Hashes of the 1-grams and 2-grams, from those of the words."""
    pairs = F.greatest(F.size(once) - 1, F.lit(0))
    return F.concat(once, F.zip_with(F.slice(once, 1, pairs), F.slice(once, 2, pairs), lambda a, b: F.xxhash64(a, b)))


def bucket_of(gram: Column, buckets: int) -> Column:
    """The high bits of a hash."""
    return F.shiftrightunsigned(gram, 65 - buckets.bit_length()).cast("int")


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO) -> DataFrame:
    """One row, one column ``weights``: the log-likelihood ratio of every bucket.

    ``trusted`` holds at most ``TRUSTED_ROWS`` ids, so it is broadcast; no text is shuffled.
    Without texts or trusted texts all weights are 0.
    """
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("trusted_id")).distinct())
    marked = docs.select("doc_id", "text").join(mark, F.col("doc_id") == F.col("trusted_id"), "left")
    hashes = let(word_hashes(words(F.col("text"))), gram_hashes)
    grams = marked.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode(hashes).alias("h"))
    counts = grams.groupBy(bucket_of(F.col("h"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    row = F.struct("b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    one = every.agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    share = F.coalesce(F.when(F.col("all_t") > 0, F.col("all_t") / F.col("all_n")), F.lit(0.0))

    def weight(x: Column) -> Column:
        return F.when(F.col("share") > 0, F.log((x["t"] + F.lit(pseudo)) / (x["n"] * F.col("share") + F.lit(pseudo)))).otherwise(0.0)

    return one.withColumn("share", share).select(F.transform("rows", weight).alias("weights"))


def repeated_words(once: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the text, from the words' hashes.

    Windows are compared by 64-bit hashes. Only a text with a repeated window is looked at closely.
    """
    zero = F.lit(0).cast("long")

    def windows(h: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), hashed)

    def repeated(s: Column) -> Column:  # places, in order, of windows whose neighbour in the order of hashes is equal
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        near = lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))
        return F.sort_array(F.array_compact(F.transform(s, lambda x, k: F.when(near(k), x["i"]))))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, zero, lambda a, g: a + g)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(let(placed, repeated), covered))

    return F.when(F.size(once) <= window, zero).otherwise(let(let(once, windows), counted))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, pseudo: float = PSEUDO, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` (doc_id, text, any others) with the columns n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr and kept; columns of ``docs`` that have one of these names give way.

    A null or empty text has no words, fails the base rules and isn't kept; its llr is 0. Repeated rows are
    judged alike, each for itself. An empty table gives an empty table.
    """
    weights = bucket_weights(docs, trusted, buckets, pseudo)
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    h, line, model = (without(docs, x) for x in ("word_hashes", "line_list", "model"))
    kept_columns = [c for c in docs.columns if c.lower() not in own]
    out = docs.select(*kept_columns).withColumns({
        h: word_hashes(words(F.col("text"))),
        line: F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE + " ", "") != ""),
        model: weights.scalar(),
    })
    def mean_weight(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(F.col(model), bucket_of(g, buckets)))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)

    out = out.withColumns({
        "n_words": F.size(h).cast("long"),
        "word_chars": F.length(F.translate(text, WHITE + " ", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
        "n_repeat_words": repeated_words(F.col(h)),
        "llr": let(gram_hashes(F.col(h)), mean_weight),
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    return out.select(*kept_columns, *own)
