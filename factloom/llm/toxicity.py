"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; each model sees the words and shape of a text and the
probabilities of the categories before it.  While fitting, those come from out-of-fold predictions (``FOLDS``
folds by a hash of the id), so a later model learns from what an earlier one says about texts it has not seen;
when scoring, from the models fitted on all training rows.

Fitting uses a bounded sample: the ``sample_size`` labelled rows with the smallest hashes of their ids.  Words
are chosen by their chi-squared against each category, where the two go together, counted over the sample by Spark; at most ``words`` per
category reach the driver, with the rows' places among them.  Scoring covers every row and whole texts, in one
pass without a shuffle.

Defined results: a null text is empty; rows with null ids or without any label do not train, and a row trains
only the categories that it has a label for; of repeated ids one text trains; a category without examples of both
kinds gets probability 0 everywhere; rows of equal texts score alike; an empty table gives an empty result; ties among
words go by the word; other columns, whatever their names, pass through ``scored``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, quoted, table

SAMPLE, WORDS, FOLDS = 12_000, 256, 5
#: Least chi-squared (about the 1e-9 tail) and least documents of a chosen word.
LEAST_CHI2, LEAST_DOCS = 40.0, 4
EDGES = ".,;:!?|()[]{}\"'*#$%&<>=-_/\\"
SHAPES = 5
PREFIXES = (4, 5, 6, 7)


def words_of(text: str) -> set[str]:
    """Distinct words in lower case, without punctuation at their ends, and their beginnings (``PREFIXES``
    characters and a bar), as inflected languages vary the ends."""
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    out = set(words)
    for n in PREFIXES:
        out |= {w[:n] + "|" for w in words if len(w) > n}
    return out - {""}


def shape_of(text: str) -> list[float]:
    """Length, and shares of symbols, upper case, bars and digits; each about 0 to 1."""
    n = max(1, len(text))
    symbols = sum(map(text.count, "#$%&*")) / n
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
    return [np.log1p(len(text)) / 12, min(1, 10 * symbols), min(1, 2 * upper), min(1, 30 * text.count("|") / n), min(1, 10 * sum(map(text.count, "0123456789")) / n)]


@dataclass
class Chain:
    """Models in order; a model's weights are for the words, the shape, the earlier probabilities and 1."""

    names: list[str]
    words: dict[str, int]
    weights: list[np.ndarray | None] = field(default_factory=list)
    own: list[set[int]] = field(default_factory=list)  # the words that each model may use

    def features(self, text: str) -> tuple[list[int], list[float]]:
        get = self.words.get
        return sorted(i for w in words_of(text) if (i := get(w)) is not None), shape_of(text)

    def predict(self, text: str) -> list[float]:
        found, shape = self.features(text)
        out: list[float] = []
        n = len(self.words)
        for w in self.weights:
            if w is None:
                out.append(0.0)
                continue
            z = float(w[found].sum()) + float(np.dot(w[n:], [*shape, *out, 1.0]))
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def _logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = 300) -> np.ndarray:
    """L2-regularised logistic regression by Adam; (rows, cols) are the words that are there, ``use`` those
    that may have a weight."""
    n_words = len(use)
    w = np.zeros(n_words + dense.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(y)) + dense @ w[n_words:]
        err = 1 / (1 + np.exp(-z)) - y
        g = np.concatenate([np.bincount(cols, err[rows], n_words), dense.T @ err]) / len(y)
        g[:-1] += 1e-5 * w[:-1]
        g[:n_words] *= use
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit_chain(names: list[str], words: dict[str, int], rows: np.ndarray, cols: np.ndarray, shapes: np.ndarray, labels: np.ndarray, folds: np.ndarray, own_words: list[set[int]] | None = None) -> Chain:
    """``labels``: 1, 0 or -1 (not known) a row and category.

    A model is fitted on the rows whose label is known.  What later models see of it is, for those rows, predicted
    by a model of the other folds, and for the rest by the model itself.
    """
    chain = Chain(names, words, own=own_words or [set(words.values())] * len(names))
    dense = np.c_[shapes, np.ones(len(shapes))]
    for j in range(len(names)):
        y, known = labels[:, j].astype(float), labels[:, j] >= 0
        use = np.isin(np.arange(len(words)), list(chain.own[j])).astype(float)

        def fitted(some: np.ndarray) -> np.ndarray:
            there, place = some[rows], np.cumsum(some) - 1
            return _logistic(place[rows[there]], cols[there], dense[some], y[some], use)

        def predicted(w: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(y)) + dense @ w[len(words) :])))

        both = lambda some: some.any() and y[some].min() < y[some].max()
        if not both(known):
            chain.weights.append(None)
            out = np.zeros(len(y))
        else:
            chain.weights.append(fitted(known))
            out = np.where(known, y[known].mean(), predicted(chain.weights[-1]))
            for f in range(FOLDS):
                own = known & (folds != f)
                if (known & ~own).any() and both(own):
                    out[known & ~own] = predicted(fitted(own))[known & ~own]
        dense = np.c_[dense[:, :-1], out, dense[:, -1:]]
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, Column]], key: str = "doc_id", text: str = "text", *, sample_size: int = SAMPLE, words: int = WORDS) -> Chain:
    """``categories``: (name, truth of ``labels``' columns), in the chain's order.

    Of rows with one id the text with the smallest hash trains.  A category without a label for a row leaves the row
    out of its own model and word choice; a label that is there in several rows is true if any of them is.
    """
    names = [c for c, _ in categories]
    truth = F.array(*[F.max(c.cast("int")) for _, c in categories])
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(truth.alias("__y")).where(F.exists("__y", lambda y: y.isNotNull()))
    sample = known.orderBy(F.xxhash64("__k"), "__k").limit(sample_size)
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(sample), "__k")
    texts = texts.groupBy("__k").agg(F.min_by("__t", F.struct(F.xxhash64("__t"), "__t")).alias("__t"), F.first("__y").alias("__y"))
    texts = checkpoint(texts.select(F.col("__k").alias(key), F.col("__t").alias(text), "__y"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(words_of(t or "")) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(2), pa.array(own, pa.list_(pa.string()))], ["y", "w"])

    pairs = texts.mapInArrow(split, "y array<int>, w array<string>").select("y", F.explode("w").alias("w"))
    count = pairs.groupBy("w").agg(*[f(F.get("y", F.lit(j))).alias(f"{c}{j}") for j in range(len(names)) for c, f in (("n", F.count), ("p", F.sum))])
    size = texts.select([f(F.get("__y", F.lit(j))).alias(f"{c}{j}") for j in range(len(names)) for c, f in (("n", F.count), ("p", F.sum))]).first()
    chosen: dict[str, int] = {}
    own_words: list[set[int]] = [set() for _ in names]
    for j in range(len(names)):
        total, positive = size[f"n{j}"], size[f"p{j}"] or 0
        if not 0 < positive < total:
            continue
        a, n = F.coalesce(F.col(f"p{j}").cast("double"), F.lit(0.0)), F.col(f"n{j}").cast("double")
        away = a - n * positive / total
        spread = n * (total - n) * (positive / total) * (1 - positive / total) / total
        chi2 = F.when((spread > 0) & (away > 0), away * away / spread).otherwise(0.0)
        best = count.where(F.col(f"n{j}") >= LEAST_DOCS).select("w", chi2.alias("c")).where(F.col("c") >= LEAST_CHI2)
        for r in best.orderBy(F.desc("c"), "w").limit(words).collect():
            own_words[j].add(chosen.setdefault(r["w"], len(chosen)))

    frame = Chain(names, chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [frame.features(t or "") for t in b.column(1).to_pylist()]
            fold = [zlib.crc32(str(k).encode()) % FOLDS for k in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.string()), pa.array(fold, pa.int32()), b.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["k", "fold", "y", "x", "s"])

    got = sorted(texts.mapInArrow(place, "k string, fold int, y array<int>, x array<int>, s array<double>").collect(), key=lambda r: r["k"])
    rows = np.array([i for i, r in enumerate(got) for _ in r["x"]], np.intp)
    cols = np.array([c for r in got for c in r["x"]], np.intp)
    shapes = np.array([r["s"] for r in got], float).reshape(-1, SHAPES)
    truths = np.array([[-1 if y is None else y for y in r["y"]] for r in got], int).reshape(-1, len(names))
    return fit_chain(names, chosen, rows, cols, shapes, truths, np.array([r["fold"] for r in got], int), own_words)


def scored(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability for each category, all in one pass over the texts; these columns take the
    place of others of their names."""
    docs = docs.drop(*[prefix + c for c in chain.names])
    own = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(text).alias("text"))

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([chain.predict(t or "") for t in texts.to_pylist()], pa.list_(pa.float64()))

    out = own.withColumn("p", of(F.col("text")))
    return out.select("row.*", *[F.get("p", F.lit(j)).alias(prefix + c) for j, c in enumerate(chain.names)])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = fit(docs, labels, [("junk", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)])
    out = scored(docs.select("doc_id", "text"), chain).drop("text")
    return out.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= 0.5).alias("toxic"))
