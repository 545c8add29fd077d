"""The contract of shards against a plain reading, and the shards as written."""

import zlib
from collections import defaultdict

import pytest

from factloom.llm import sharding as S

SF = "/root/testdata/sf0.01"


def tables(spark):
    """Name -> (id, text) rows: the cases that are hard to split."""
    some = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return {
        "whole": some, "a third of null keys": [(None if i % 3 == 0 else i, t) for i, t in some], "null keys only": [(None, t) for _, t in some], "one key with a third of the rows": [(7 if i % 3 == 0 else i, t) for i, t in some],
        "equal rows": [(1, "x" * 50)] * 1000, "three rows": [(1, "a"), (2, None), (None, "ü" * 9)], "one giant": [(0, "y" * 1_000_000), *some], "no rows": [],
    }


def size(text):
    return len((text or "").encode()) + 16


@pytest.mark.parametrize("name", ["whole", "a third of null keys", "null keys only", "one key with a third of the rows", "equal rows", "three rows", "one giant", "no rows"])
def test_contract(spark, name):
    rows = tables(spark)[name]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.assign_shards(df, 40).collect()
    assert sorted((r["k"] is not None, r["k"], r["size"], r["crc"]) for r in got) == sorted((i is not None, i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, held, keys = defaultdict(list), [0] * 40, defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        keys[r["shard"]].append((r["k"] is not None, r["k"] or 0))
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        # Boundaries lie at equal shares, each off by a record at most.
        assert max(abs(b - sum(held) / 40) for b in held) <= max(size(t) for _, t in rows)
        # Ranges: shards follow one another in the keys' order, nulls first.
        order = [keys[s] for s in sorted(keys)]
        assert all(max(a) <= min(b) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("name", ["a third of null keys", "one key with a third of the rows", "equal rows"])
def test_no_range_is_overfull(spark, name, monkeypatch):
    """Windows hold one range each; none has more than about two parts of what is due."""
    seen = []
    place = S._place
    monkeypatch.setattr(S, "_place", lambda splitters, ddl: seen.append(splitters) or place(splitters, ddl))
    rows = tables(spark)[name]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    S.assign_shards(df, 40, fine=64, sample_size=64).count()
    records = S.records_of(df)
    cells = defaultdict(list)
    for r in records.withColumn("cell", place(seen[-1], "bigint")).collect():
        cells[r["cell"]].append(r["size"])
    assert max(sum(c) - max(c) for c in cells.values()) <= 2 * sum(size(t) for _, t in rows) / 64


def test_sampled_splitters_follow_bytes(spark):
    """A few large records hold most bytes: splitters crowd around them."""
    df = spark.createDataFrame([(i, "z" * (5000 if i < 100 else 10)) for i in range(2000)], "doc_id long, text string")
    got = S.assign_shards(df, 10, fine=32, sample_size=500).collect()
    assert sum(r["shard"] < 8 for r in got) < 200


def test_write_shards(spark, tmp_path):
    rows = [(i % 90, f"text {i} " * (i % 7), f"p{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__shard` string, slot int")
    S.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "__shard", "slot", "___shard"}
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "__shard", "slot").collect()) == sorted(rows)
    by = defaultdict(int)
    for r in back.collect():
        by[r["___shard"]] += size(r["text"])
    assert len(by) == 5 and max(by.values()) - min(by.values()) <= 2 * max(size(r[1]) for r in rows)
    S.write_shards(df.where("doc_id < 0"), str(tmp_path / "none"), 5)
