"""Quality rules, native: text statistics and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` bins.  Two multinomials over the bins, one from trusted
target documents (labelled of good quality) and one from the whole raw corpus, give each bin the log ratio of
its probabilities; the target is smoothed towards the raw corpus.  A document's score is the mean over all its n-grams, so it does
not depend on length, and every document is kept or rejected by the same threshold: no sampling by weight.

Everything runs in DataFrame functions.  The raw counts cover all rows and all words: hash and partial sums in
the scan's stage, then at most ``BUCKETS`` rows a task are exchanged.  Trusted documents are a bounded sample
of the labelled ids (the smallest by hash), so their join is a broadcast of proven size.  The table of ratios
has a fixed size and goes into the plan as a constant.

Defined results: a null text has no words, and scores 0; with no trusted documents all ratios are 0; null ids
are never trusted; repeated rows count as often as they are there; an empty table gives an empty result; other columns,
whatever their names, pass through ``rated`` (those named like a rating give way to it) and all through ``keep_good``.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, constant, packed, quoted, table, unpacked

BUCKETS = 16_384
#: Trusted documents that the target is fitted on, at most.
TRUSTED = 20_000
#: Weight of the raw distribution in the target's: a share of the target's n-grams, and some n-grams in any
#: case, so a small target makes weaker ratios.
PRIOR, PRIOR_GRAMS = 0.2, 100_000
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.12
SYMBOLS = "#*$%&|<>"
RATINGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__words", words_of(F.col(text))).withColumn("__n", F.size("__words"))


def bin_of(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def with_hashes(worded: DataFrame) -> DataFrame:
    """``__h``: hashes of the words; ``__pairs``: of all pairs of neighbours, made from theirs."""
    n = F.greatest(F.col("__n") - 1, F.lit(0))
    hashed = worded.withColumn("__h", F.transform("__words", lambda x: F.xxhash64(x)))
    return hashed.withColumn("__pairs", F.zip_with(F.slice("__h", 1, n), F.slice("__h", 2, n), lambda a, b: F.xxhash64(a, b)))


def ratios(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """log(target / raw) of each bin."""
    trusted = labels.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    trusted = trusted.orderBy(F.xxhash64("__k"), "__k").limit(TRUSTED)
    marked = docs.select(key, text).join(F.broadcast(trusted), F.col(key) == F.col("__k"), "left")
    worded = with_words(marked.select(text, F.col("__k").isNotNull().cast("long").alias("__t")), text)
    # A row for each word, beside the next one: from here on all is compiled code.
    each = worded.select("__t", F.explode(F.arrays_zip(F.col("__words").alias("w"), F.slice("__words", 2, F.greatest("__n", F.lit(0))).alias("x"))).alias("z")).select("__t", F.xxhash64("z.w").alias("h"), F.col("z.x").alias("x"))
    pair = F.when(F.col("x").isNotNull(), bin_of(F.xxhash64("h", F.xxhash64("x"))))
    bins = each.select("__t", F.explode(F.array(bin_of(F.col("h")), pair)).alias("b")).where("b is not null")
    sums = bins.groupBy("b").agg(F.count("*").alias("raw"), F.sum("__t").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in sums:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * BUCKETS
    # (t + p * T * r / R) / (T + p * T) over r / R; bins that no document has are never looked up.
    prior = PRIOR + PRIOR_GRAMS / all_target
    return [log((t * all_raw / (r * all_target) + prior) / (1 + prior)) if r else 0.0 for r, t in zip(raw, target, strict=True)]


def _symbols(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    rest = body
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(body) - F.octet_length(rest)).cast("long")  # each is one byte


def _repeated_words(worded: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in windows of three that the text holds twice or more.

    The windows' hashes are sorted with their places; those with an equal neighbour repeat, and the words
    they cover are counted over their places in order.
    """
    n = F.greatest(F.col("__n") - 2, F.lit(0))
    # A window is a pair and the word behind it; texts of up to three words have no two.
    grams = F.zip_with(F.slice("__pairs", 1, n), F.slice("__h", 3, n), lambda a, b: F.xxhash64(a, b))
    hashed = worded.withColumn("__g", grams)
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    # Only where there is a repeated window at all is the rest needed.
    placed = F.when(some, F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = hashed.withColumn("__s", placed)
    s = F.col("__s")
    twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    places = sorted_.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum"))
    covered = F.aggregate("__p", start, step, lambda a: a["sum"])
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__g", "__s", "__p")


def rated(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept, which
    take the place of columns of these names."""
    own = [c for c in docs.columns if c not in RATINGS]
    rows = docs.select(F.struct(*[quoted(c) for c in own]).alias("__row"), quoted(key).alias("__key"), quoted(text).alias("__text"))
    weights = constant(ratios(rows.select(F.col("__key").alias(key), F.col("__text").alias(text)), labels, key, text), "array<double>")
    worded = with_words(rows, "__text")
    n = F.col("__n")
    lines = F.filter(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = worded.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _symbols(F.col("__text")),
        "__lines": lines,
    })
    counted = counted.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    counted = _repeated_words(with_hashes(counted))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, h: a + F.get(weights, bin_of(h)))
    scored = counted.withColumn("score", F.when(n > 0, (total("__h") + total("__pairs")) / (F.size("__h") + F.size("__pairs"))).otherwise(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # A generator of one row: a filter above does not move below it, where it would repeat all this work.
    return scored.select(F.inline(F.array(F.struct("__row", *RATINGS)))).select("__row.*", *RATINGS)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows, with their own columns, whatever their names."""
    kept = rated(packed(docs, key, text), labels.withColumnRenamed(key, "key"), "key", "text").where("kept")
    return unpacked(kept, docs.columns, key, text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
