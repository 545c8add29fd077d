"""SimHash near-duplicates by a grid range-join over segment popcounts, verified exactly.

Fingerprints: the words of the whole text, lower-cased in A-Z, in shingles of ``width`` words with repeats;
XXH64 of each; a bit is set if more than half the hashes have it.

Linking: a fingerprint maps to the counts of set bits in 32 segments of two bits.  The Manhattan distance of
two such vectors is at most the Hamming distance of the fingerprints, so links within ``radius`` bits lie in
the same or near cells of the grid.  The 32 axes are dealt into ``radius + 2`` bands; if the vectors' distance
is at most ``radius``, two bands at least have distance 0, so each fingerprint goes to the cells of all pairs
of bands (15 for radius 4) and meets every partner in one of them.  Inside a cell, the Manhattan distance is
tested first and the Hamming distance verifies.

Only distinct fingerprints go to the grid, so copies of any number cost one row.  A cell returns a spanning
forest of its links, not its pairs.  A cell with more than ``CELL`` fingerprints is compared in blocks: each
pair of blocks is a task of its own, so nothing is capped.  Components then grow by large-star and
small-star steps over the forest's edges, with a checkpoint between rounds; from ``SMALL`` edges on, one
task settles what is left.

Defined results: null and blank texts have fingerprint zero and link like any other; rows with a null id get
the component of their fingerprint (null if no row there has an id); repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import checkpoint, hot_join, packed, release, sweep, table, unpacked

SEED = 42
RADIUS = 4
SEGMENTS = 32
CELL = 8192
#: So many edges are 4 MB.  A round deals edges out some ten times, and each task of it leaves files of a disk block each.
SMALL = 1 << 18


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit fingerprint as a signed integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # exactly A-Z and the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - width + 1)
    a, z = starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i : j - 1], SEED) for i, j in zip(a, z, strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str, width: int, name: str) -> DataFrame:
    """``docs`` with a column more; the text goes to Python in bounded batches."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(name, of(F.col(text)))


def embed(prints: np.ndarray) -> np.ndarray:
    """Set bits of each of the 32 segments, packed in two bits each; 0, 1, 2 are written 00, 01, 11, so the
    Manhattan distance of two vectors is the number of differing bits of their codes."""
    x = prints.view(np.uint64)
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((x | (x >> one)) & odd) | (((x & (x >> one)) & odd) << one)


def _bands(radius: int) -> list[np.uint64]:
    """Masks that deal the 32 axes into radius + 2 bands."""
    out = []
    for band in np.array_split(np.arange(SEGMENTS), radius + 2):
        out.append(np.uint64(sum(3 << (2 * int(i)) for i in band)))
    return out


def _cells(prints: DataFrame, radius: int) -> DataFrame:
    """(t, cell, fp): one row for every pair of bands."""
    odd, x, half = F.lit(0x5555555555555555), F.col("fp"), F.shiftrightunsigned("fp", 1)
    code = x.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(odd), 1))
    masks = [int(np.uint64(a | b).view(np.int64)) for a, b in combinations(_bands(radius), 2)]
    cells = F.array(*[F.struct(F.lit(i).alias("t"), F.col("v").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    return prints.withColumn("v", code).select("fp", F.explode(cells).alias("c")).select("c.t", "c.cell", "fp")


def _forest(own: np.ndarray, other: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one, some rows at a time."""
    same = own is other
    ours, theirs = embed(own), embed(other)
    left, right = own.view(np.uint64), other.view(np.uint64)
    n = len(own)
    parent = list(range(n if same else n + len(other)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, n, step):
        near = np.bitwise_count(ours[at : at + step, None] ^ theirs[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        fit = np.bitwise_count(left[i] ^ right[j]) <= radius
        if same:
            fit &= i < j
        for a, k in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
            x, y = root(a), root(k if same else n + k)
            if x != y:
                parent[y] = x
                yield int(own[a]), int(other[k])


def _edges_of_cell(radius: int):
    def run(key: tuple, batch: pa.Table) -> pa.Table:
        part, fp = batch.column("part").to_numpy(), batch.column("fp").to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        own = np.sort(fp[part == i])
        other = own if i == j else np.sort(fp[part == j])
        found = list(_forest(own, other, radius))
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return run


def _small_cells(radius: int):
    """Edges of all the cells that a partition holds; the partition is sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        rest: tuple[tuple, np.ndarray] | None = None

        def done(fp: np.ndarray) -> None:
            if len(fp) > 1:
                pairs.extend(_forest(fp, fp, radius))

        for batch in batches:
            t, cell, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (cell[1:] != cell[:-1])])
            for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(t)], strict=True):
                name, own = (int(t[a]), int(cell[a])), fp[a:z]
                if rest and rest[0] == name:
                    rest = (name, np.r_[rest[1], own])
                else:
                    if rest:
                        done(rest[1])
                    rest = (name, own)
            if len(pairs) > 50_000:
                yield pa.record_batch({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})
                pairs = []
        if rest:
            done(rest[1])
        yield pa.record_batch({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})

    return run


def link_forest(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(u, v): enough of the links between distinct fingerprints to give their components."""
    cells = _cells(prints, radius)
    sizes = cells.groupBy("t", "cell").agg(F.count("*").alias("n"))
    sizes = checkpoint(sizes.where("n > 1"))  # most cells hold one fingerprint
    parts = sizes.where(F.col("n") > cell).select("t", "cell", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    small = cells.join(sizes.where(F.col("n") <= cell).select("t", "cell"), ["t", "cell"], "left_semi")
    out = small.repartition("t", "cell").sortWithinPartitions("t", "cell").mapInArrow(_small_cells(radius), "u long, v long")
    # Crowded cells: each fingerprint goes to all pairs of blocks that its block is in.
    split = cells.join(parts, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    split = split.select("t", "cell", "fp", "part", F.explode(pair).alias("p")).select("t", "cell", "p.i", "p.j", "part", "fp")
    # Dealt anew: else one task would take all pairs of blocks of a cell, as the join left them.
    crowded = split.repartition("t", "cell", "i", "j").groupBy("t", "cell", "i", "j").applyInArrow(_edges_of_cell(radius), "u long, v long")
    return out.unionByName(crowded)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a whole graph, by union and find."""
    ends = [np.stack([b.column(i).to_numpy() for i in range(2)]) for b in batches]
    names, at = np.unique(np.concatenate([np.empty((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in at.reshape(2, -1).T.tolist():
        x, y = root(i), root(j)
        parent[max(x, y)] = min(x, y)  # names are sorted, so a root is the smallest
    roots = np.array([root(i) for i in range(len(names))], np.int64)
    other = roots != np.arange(len(names))
    yield pa.record_batch({"node": pa.array(names[other]), "root": pa.array(names[roots[other]])})
    release()


def components(edges: DataFrame, most_rounds: int = 60, few: int = SMALL) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes other than it.

    A graph of at most ``few`` edges is settled in one task.  A larger one shrinks first, by alternating large-star and
    small-star steps; every round is two aggregations and two joins, and ends in a checkpoint.  A component's smallest
    node may have a third of all edges: in the large star hot nodes meet their edges by broadcast.  In the small star a
    node has no more edges than distinct minima among its neighbours.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sweep(edges.sparkSession)  # the shuffles that found the edges are the largest
    last, n = None, edges.count()
    for _ in range(most_rounds):
        if n <= few:
            return checkpoint(edges.coalesce(1).mapInArrow(_settled, "node long, root long"))
        # Large star: every larger neighbour of a node points to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = hot_join(both, low, "u", "n", 2 * n).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, n = now, now[0]
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 5, radius: int = RADIUS) -> DataFrame:
    """(key, __mark, __fp, __root, __component) of every row: the text's hash, the fingerprint, the group's
    smallest fingerprint, and the smallest key in the group."""
    marked = with_fingerprint(docs.select(key, text), text, width, "__fp")
    marked = checkpoint(marked.select(key, F.xxhash64(text).alias("__mark"), "__fp"))
    prints = checkpoint(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(key).alias("least"), F.count("*").alias("rows")))
    roots = components(link_forest(prints.select("fp"), radius))
    named = checkpoint(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    smallest = checkpoint(named.groupBy("root").agg(F.min("least").alias("__component"), F.count("*").alias("n"), F.sum("rows").alias("rows")))
    sizes = smallest.agg(F.sum("n"), F.sum("rows")).first()
    # A component may hold a third of the fingerprints, and a fingerprint a third of the rows.
    named = checkpoint(hot_join(named, smallest.drop("rows"), "root", "n", sizes[0] or 0).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), "__component", "rows"))
    return hot_join(marked, named, "__fp", "rows", sizes[1] or 0).select(key, "__mark", "__fp", "__root", "__component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group that pairs of shingle similarity ``least`` or more make (see ``near_copies``): the
    one with the smallest key, nulls last, then the smallest text hash.  Of rows with equal key and text one stays."""
    nil = F.lit("0").cast(docs.schema[key].dataType)
    rows = packed(docs, key, text)
    marked = near_copies.with_node(rows.select("key", "text"), "text", width, least)
    marked = checkpoint(marked.select("key", F.xxhash64("text").alias("mark"), "__set.node", "__set.cells"))
    rough = components(near_copies.rough_edges(marked.select("node", "cells").dropDuplicates(["node"])))
    rough = rough.unionByName(rough.select(F.col("root").alias("node"), "root").distinct())
    # Of each node one row, before any join: a node may be a third of all rows.
    first = F.struct(F.col("key").isNull().alias("z"), F.coalesce(F.col("key"), nil).alias("k"), F.col("mark").alias("m"))
    nodes = checkpoint(marked.groupBy("node").agg(F.min("mark").alias("mark"), F.min(first).alias("first")))
    picks = nodes.join(rough, "node").select("node", "root", "mark")
    texts = rows.select("text", F.xxhash64("text").alias("mark")).join(picks, "mark").dropDuplicates(["node"])
    roots = components(near_copies.exact_edges(texts.select("root", "node", "text"), width, least))
    found = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("s"))
    names = ["z", "k", "m"]
    named = rows.withColumns({"k": F.coalesce(F.col("key"), nil), "z": F.col("key").isNull(), "m": F.xxhash64("text")})
    kept = named.dropDuplicates(names).join(found.select("s.z", "s.k", "s.m").distinct(), names, "left_semi")
    return unpacked(kept, docs.columns, key, text)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, over four-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))
