"""Sampled splitters: weighted key samples choose the quantile boundaries of range shards.

``assign_shards`` gives every record a shard and a gapless slot in it so that the shards hold nearly
equal bytes (each boundary is off by at most one record).  Steps, all of them DataFrame operations:

1. One scan keeps (key, size, text checksum) and a record number, written to the checkpoint folder.
2. Every record enters a sample with a probability in proportion to its size, decided by a hash, so the
   sample's quantiles are quantiles of bytes.  At most about ``sample_size`` rows reach the driver.
3. Its quantiles of (key, tie) split the key space into ``fine`` ranges; ``tie`` is a hash of the record
   number, so one key with a third of all rows spans as many ranges as its bytes need.
4. Exact sums per range find overfull ranges; these are sampled again and subdivided until none is overfull.
5. Running sums inside each range plus the sums of the ranges before give each record's exact place in
   the global order of (key, tie), and with it its shard.  Only (range -> sum) tables, whose size does
   not depend on the data, reach the driver.

Nulls: a null text has size 16 and the checksum of no bytes; null keys come first, and as
many ranges as their bytes need are theirs.  Repeated rows are separate records; ties go by a hash of the record's
number.  An empty table gives an empty result.  Other columns of the input, whatever their names, play no part here
and are carried by ``write_shards``.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, constant, quoted, table

OVERHEAD = 16
#: Times that ranges are subdivided, at most; each divides what is left by about the parts asked for.
ROUNDS = 8


def _place(splitters: list[tuple], ddl: str) -> Column:
    """Number of splitters (k, t) at or below the record's (k, t), by a search of two levels."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    fine = constant([{"k": k, "t": t} for k, t in splitters], f"array<struct<k:{ddl},t:bigint>>")
    coarse = constant([{"k": k, "t": t} for k, t in splitters[::step]], f"array<struct<k:{ddl},t:bigint>>")
    here = F.struct(F.col("k"), F.col("t"))
    block = F.size(F.filter(coarse, lambda s: s <= here))
    inside = F.size(F.filter(F.slice(fine, (block - 1) * step + 1, F.lit(step)), lambda s: s <= here))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _order(at: tuple) -> tuple:
    """Where a record (k, t) stands, as Spark orders structs: null keys first."""
    return (at[0] is not None, 0 if at[0] is None else at[0], at[1])


def _sampled(records: DataFrame, rate: Column) -> list[tuple]:
    """Keys of the records that a hash of their number picks with the probability ``rate``."""
    draw = F.pmod(F.xxhash64(F.col("rid"), F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    picked = records.where(draw < rate).select("k", "t")
    return sorted(((r["k"], r["t"]) for r in picked.collect()), key=_order)


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}, key=_order) if keys else []


def records_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, t, rid, size, crc) of every record, in the checkpoint folder so that rid stays what it is."""
    body = F.coalesce(F.col(text), F.lit(""))
    numbered = docs.select(
        F.col(key).alias("k"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("rid"),
    )
    return checkpoint(numbered).withColumn("t", F.xxhash64("rid"))


def assign_shards(
    docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", *, fine: int = 1024, sample_size: int = 20_000
) -> DataFrame:
    """(k, rid, size, crc, shard, slot) for every record; see the module's text."""
    records = records_of(docs, key, text)
    ddl = dict(records.dtypes)["k"]
    total = records.agg(F.sum("size")).first()[0] or 0
    if not total:
        return records.select("k", "rid", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    splitters = _quantiles(_sampled(records, F.col("size") * (sample_size / total)), fine)
    # Overfull ranges: sampled again, as many splitters more as their bytes ask for, until none is left.  A record that
    # is larger than a range by itself does not make one overfull.
    full = 2 * total / fine
    for _ in range(ROUNDS):
        placed = records.withColumn("cell", _place(splitters, ddl))
        held = placed.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("top")).collect()
        sums = {r["cell"]: (r["b"], r["n"]) for r in held}
        overfull = {r["cell"]: -(-r["b"] // int(full)) + 1 for r in held if r["b"] - r["top"] > full}
        if not overfull:
            break
        rates = {c: min(1.0, 16 * parts / sums[c][1]) for c, parts in overfull.items()}
        rate = constant([rates.get(c, 0.0) for c in range(len(splitters) + 1)], "array<double>")
        found: dict[int, list[tuple]] = {}
        for k in _sampled(placed, F.get(rate, F.col("cell"))):
            found.setdefault(bisect_right(splitters, _order(k), key=_order), []).append(k)
        splitters = sorted({*splitters, *(s for c, ks in found.items() for s in _quantiles(ks, overfull.get(c, 1)))}, key=_order)

    before, at = [], [0, 0]
    for c in range(len(splitters) + 1):
        before.append({"b": at[0], "n": at[1]})
        at = [at[0] + sums.get(c, (0, 0))[0], at[1] + sums.get(c, (0, 0))[1]]
    base = F.get(constant(before, "array<struct<b:bigint,n:bigint>>"), F.col("cell"))
    order = Window.partitionBy("cell").orderBy("k", "t", "rid")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("upto", base["b"] + F.sum("size").over(running)).withColumn(
        "place", base["n"] + F.row_number().over(order) - 1
    )
    # A record goes where its middle byte falls: integers only, the same at every size.
    middle = F.expr(f"(2 * upto - size) * {n_shards} div {2 * total}")
    ranked = ranked.withColumn("shard", F.least(F.lit(n_shards - 1), middle.cast("int")))
    first = {r["shard"]: r["p"] for r in ranked.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    start = F.get(constant([first.get(s, 0) for s in range(n_shards)], "array<bigint>"), F.col("shard"))
    return ranked.select("k", "rid", "size", "crc", "shard", (F.col("place") - start).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes the records, all columns, as one folder ``__shard=n`` per shard, in slot order; where the records have a
    column of that name, the folders' has more underscores."""
    part = "__shard"
    while part in docs.columns:
        part = "_" + part
    numbered = checkpoint(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")))
    places = assign_shards(numbered.select(F.col("row")[key].alias("k"), F.col("row")[text].alias("text")), n_shards, "k", "text")
    # Both are numbered over the same partitions in the same order, so the numbers agree.
    out = numbered.join(places.select("rid", "shard", "slot"), "rid").repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("row.*", F.col("shard").alias(part)).write.partitionBy(part).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    out = assign_shards(table(spark, sf_dir, "documents"), 40)
    return out.select(
        F.col("k").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
