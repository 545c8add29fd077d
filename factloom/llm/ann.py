"""Nearest neighbours: an inverted file with product-quantised residuals, bounds and exact reranking.

Coarse centroids and codebooks are fitted with k-means on a bounded sample (``sample_size`` vectors, those
with the smallest hashes of their ids).  Every vector is indexed: it goes to its nearest centroid's list with
the codes of its residual and the length of what they leave out.  A query visits the lists of its ``probes``
nearest centroids, more if they hold too few vectors; then every other list that may hold a nearer vector, by
the centroid's distance, the list's radius and the ``k``-th distance so far.  Inside a list, asymmetric
distances come from a table per query; the ``shortlist`` nearest by them (ties to smaller ids) are reranked by
exact distance on the original vectors, and so is every vector whose asymmetric distance less its error does
not rule it out.  The sample and the parameters thus decide the work, not the result, whatever the vectors.

A list is dealt into chunks of about ``CHUNK`` vectors by a hash of the id, and the queries that visit it into
chunks likewise, so neither a crowded list nor a vector that a third of all rows share lands in one task; each
pair of chunks returns its ``k`` best and the best of these remain.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; a row with the query's own id is the query's own; of query rows with one id one
searches; with fewer than k candidates all are returned; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

CHUNK, QUERIES = 4096, 2048
CODES = 256
#: More than the rounding of doubles can change a distance by, relative to the lengths that it comes from.
SLACK = 1e-9


@dataclass
class Index:
    """What the fit gives: a fixed size whatever the input."""

    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codes x width

    def _split(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)

    def nearest_lists(self, x: np.ndarray) -> np.ndarray:
        return _squared(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far the vectors are from what the codes say."""
        parts = self._split(x - self.centroids[lists])
        codes = np.stack([_squared(parts[:, j], self.books[j]).argmin(1) for j in range(len(self.books))], 1)
        left = sum(((parts[:, j] - self.books[j][codes[:, j]]) ** 2).sum(1) for j in range(len(self.books)))
        return codes.astype(np.uint8), np.sqrt(left)

    def tables(self, q: np.ndarray, of: int) -> np.ndarray:
        """Squared distances of the residual's parts to all codes: queries x subspaces x codes."""
        parts = self._split(q - self.centroids[of])
        return ((parts[:, :, None, :] - self.books[None]) ** 2).sum(3)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = np.concatenate([_squared(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = count > 0
        centres[some] = sums[some] / count[some, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int, seed: int = 0) -> Index:
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, lists, rng)
    residual = sample - centroids[_squared(sample, centroids).argmin(1)]
    width = -(-sample.shape[1] // subspaces)
    parts = np.pad(residual, ((0, 0), (0, subspaces * width - sample.shape[1]))).reshape(len(sample), subspaces, width)
    books = np.zeros((subspaces, CODES, width))
    for j in range(subspaces):
        own = _kmeans(parts[:, j], CODES, rng, 5)
        books[j, : len(own)] = own
        books[j, len(own) :] = own[:1]
    return Index(centroids, books)


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by (score, id)."""
    if len(score) > k:
        edge = np.partition(score, k - 1)[k - 1]
        near = np.flatnonzero(score <= edge)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], score[near]))[:k]]


def _search(index: Index, k: int, shortlist: int):
    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if held.num_rows and asked.num_rows:
            at_list = key[0].as_py()
            ids, x, off = held.column("id").to_numpy(), _matrix(held.column("v")), held.column("off").to_numpy()
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.intp)
            names, q, most = asked.column("query").to_numpy(), _matrix(asked.column("q")), asked.column("most").to_numpy()
            around, q_around = x - index.centroids[at_list], q - index.centroids[at_list]
            norms, q_norms = (around * around).sum(1), (q_around * q_around).sum(1)
            for at in range(0, len(names), 64):
                tables = index.tables(q[at : at + 64], at_list)
                # By products, so with an error; it is small as both are seen from the centroid.
                rough = norms[None, :] - 2 * q_around[at : at + 64] @ around.T + q_norms[at : at + 64, None]
                rough -= SLACK * (norms[None, :] + q_norms[at : at + 64, None])
                for name, point, bound, lut, low in zip(names[at : at + 64].tolist(), q[at : at + 64], most[at : at + 64].tolist(), tables, rough, strict=True):
                    about = np.zeros(len(ids))
                    for j in range(codes.shape[1]):
                        about += lut[j, codes[:, j]]
                    others = ids != name
                    about[~others] = np.inf
                    near = _top(about, ids, shortlist)
                    near = near[others[near]]
                    exact = np.sqrt(((x[near] - point) ** 2).sum(1))
                    if len(near) >= k:
                        bound = min(bound, float(np.partition(exact, k - 1)[k - 1]))
                    # What the codes cannot rule out, then what the products cannot; not-a-number rules nothing out.
                    about = np.sqrt(about)
                    others[near] = False
                    rest = np.flatnonzero(others & ~(about * (1 - SLACK) - off * (1 + SLACK) > bound * (1 + SLACK)))
                    rest = rest[~(low[rest] > bound * bound * (1 + SLACK))]
                    near, exact = np.concatenate([near, rest]), np.concatenate([exact, np.sqrt(((x[rest] - point) ** 2).sum(1))])
                    best = _top(exact, ids[near], k)
                    out += [(name, int(ids[near[b]]), float(exact[b])) for b in best.tolist()]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def search(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", *, k: int = 10, lists: int | None = None,
    probes: int | None = None, subspaces: int = 16, shortlist: int = 128, sample_size: int = 20_000,
) -> DataFrame:
    """(query, rank, id, score): the k nearest for each row that ``queries`` marks."""
    given = vectors.where(_usable(F.col(vector)) & F.col(key).isNotNull())
    given = given.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks"))
    sizes = {r["d"]: r["n"] for r in given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    empty = vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    if not sizes:
        return empty
    dim = max(sizes, key=lambda d: (sizes[d], d))
    n = sizes[dim]
    given = given.where(F.size("v") == dim)
    # The square root of the rows, so lists grow as their number does; bounded by what the sample supports.
    lists = lists or max(1, min(int(n**0.5), sample_size // 16))
    # Vectors without clusters, as in the test tables, have nine in ten of the nearest in this share of the lists.
    probes = probes or max(8, -(-lists * 7 // 10))
    sample = given.orderBy(F.xxhash64("id"), "id").limit(sample_size).select("v").toArrow()
    index = fit(_matrix(sample.column("v")), lists, min(subspaces, dim), 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"))
                own = index.nearest_lists(x).argmin(1)
                codes, off = index.encode(x, own)
                reach = np.sqrt(((x - index.centroids[own]) ** 2).sum(1))
                yield pa.record_batch([pa.array(own, pa.int32()), part.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(reach), part.column("v"), part.column("asks")], ["list", "id", "code", "off", "reach", "v", "asks"])

    kind = given.schema["v"].dataType.simpleString()
    indexed = checkpoint(given.mapInArrow(listed, f"list int, id long, code binary, off double, reach double, v {kind}, asks boolean"))
    count, radius = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("reach").alias("far")).collect():
        count[r["list"]], radius[r["list"]] = r["n"], r["far"]

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                order = index.nearest_lists(_matrix(part.column("q"))).argsort(1, kind="stable")
                # As many more lists as it takes to see all that are needed.
                enough = (np.cumsum(count[order], 1) < 4 * k + 2).sum(1) + 1
                take = np.minimum(np.maximum(probes, enough), len(count))
                lists = pa.array([o[:t][count[o[:t]] > 0].astype(np.int32) for o, t in zip(order, take, strict=True)], pa.list_(pa.int32()))
                yield pa.record_batch([part.column("query"), part.column("q"), lists], ["query", "q", "lists"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                q, most = _matrix(part.column("q")), part.column("most").to_numpy()
                apart = index.nearest_lists(q)
                sure = np.sqrt(np.maximum(apart - SLACK * ((q * q).sum(1)[:, None] + (index.centroids**2).sum(1)[None, :]), 0))
                may = (count > 0)[None, :] & ~(sure - radius[None, :] * (1 + SLACK) > most[:, None] * (1 + SLACK))
                lists = pa.array([np.setdiff1d(np.flatnonzero(m), seen).astype(np.int32) for m, seen in zip(may, part.column("lists").to_pylist(), strict=True)], pa.list_(pa.int32()))
                yield pa.record_batch([part.column("query"), part.column("q"), lists, part.column("most")], ["query", "q", "lists", "most"])

    spark = vectors.sparkSession
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    names = ["list", "chunk", "turn"]

    def visited(asked: DataFrame) -> DataFrame:
        asked = asked.select(F.explode("lists").alias("list"), "query", "q", "most")
        asks = np.zeros(len(count), np.int64)
        for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect():
            asks[r["list"]] = r["n"]
        rows = [(i, max(1, -(-int(c) // CHUNK)), max(1, -(-int(a) // QUERIES))) for i, (c, a) in enumerate(zip(count, asks, strict=True)) if a]
        parts = F.broadcast(spark.createDataFrame(rows, "list int, chunks int, turns int"))  # one row a list
        held = indexed.join(parts, "list").select("list", deal("id", "chunks").alias("chunk"), every("turns").alias("turn"), "id", "code", "off", "v")
        asked = asked.join(parts, "list").select("list", every("chunks").alias("chunk"), deal("query", "turns").alias("turn"), "query", "q", "most")
        found = held.groupBy(*names).cogroup(asked.groupBy(*names)).applyInArrow(_search(index, k, shortlist), "query long, id long, score double")
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")

    asked = indexed.where("asks").select(F.col("id").alias("query"), F.col("v").alias("q")).dropDuplicates(["query"])
    # Written, as both searches must hold to the same lists.
    asked = checkpoint(asked.mapInArrow(nearby, f"query long, q {kind}, lists array<int>"))
    near = checkpoint(visited(asked.withColumn("most", F.lit(float("inf")))))
    most = near.where(F.col("rank") == k).select("query", F.col("score").alias("most"))
    more = asked.join(most, "query", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    more = checkpoint(more.mapInArrow(others, f"query long, q {kind}, lists array<int>, most double"))
    found = near.drop("rank").unionByName(visited(more).drop("rank"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
