"""Against a brute-force reading of the contract."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import suffix_dedup as S


def brute(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if i is not None else ():
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\0 ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(9, 40))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 9):] if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(7, rows[7][1]), (7, rows[9][1] + "x"), (130, None), (131, ""), (None, rows[3][1]), (132, "ab" * 200), (133, "x" + "ab" * 300), (134, "\0" * 80), (135, "q" + "\0" * 120), (-5, passages[0])]
    rows += [(200 + i, rows[5][1]) for i in range(60)]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = S.suffix_dedup(df, S._Digest(), ["doc_id"]).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_long_text_over_chunks(spark):
    rng = np.random.default_rng(3)
    body = bytes(rng.integers(97, 123, 3 * S.CHUNK, dtype=np.uint8)).decode()
    rows = [(1, body), (2, "z" * 30 + body[S.CHUNK - 100 : S.CHUNK + 100]), (3, body[:49] + "-" + body[50:98])]
    got = {r["doc_id"]: r for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), S._Digest(), ["doc_id"]).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (0, 200, 0)


def test_common_hashes_spread(spark, monkeypatch):
    """The way of very common hashes gives the same result."""
    rows = rows_of(4)
    keys = ("doc_id", "__mark")
    import pyarrow as pa

    marks = [int.from_bytes(hashlib.md5((t or "").encode()).digest()[:7], "little") for _, t in rows]
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] or "" for r in rows], "__mark": marks})
    monkeypatch.setattr(S, "COMMON", 1)
    key = (pa.scalar(0, pa.int32()),)
    sent = S._hashes_of_block(keys, "text", 3, 50, 20)(key, docs).to_pylist()
    flags = [x for b in range(3) if (own := [s for s in sent if s["bucket"] == b]) for x in S._shared((pa.scalar(b, pa.int32()),), pa.Table.from_pylist(own)).to_pylist()]
    segs = S._segments_of_block(keys, "text", 3, 50, 20)(key, docs, pa.Table.from_pylist(flags)).to_pylist()
    found = [x for b in range(3) if (own := [s for s in segs if s["bucket"] == b]) for x in S._match(50)((pa.scalar(b, pa.int32()),), pa.Table.from_pylist(own)).to_pylist()]
    out = S._cut_block(keys, "text", ["doc_id"], S._Digest())(key, docs, pa.Table.from_pylist(found)).to_pylist()
    assert sorted([tuple(r.values()) for r in out], key=str) == brute(rows)


def test_deduplicate_keeps_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "p" * 20 + "tail of it all, much longer than fifty bytes in total", "x", 5), (2, "tail of it all, much longer than fifty bytes in total", "y", 6), (3, None, None, 7), (4, "ü" * 40, "z", 8), (5, "aü" * 1 + "ü" * 39 + "b", "w", 9)], "doc_id long, text string, block string, bucket int")
    got = {r["doc_id"]: r for r in S.deduplicate(df).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3]["text"] == "" and got[5]["text"] == "ab" and got[4]["block"] == "z"
    assert S.deduplicate(df.where("doc_id > 99")).count() == 0


def test_level_family():
    """Against a dictionary, with a stored family that takes further batches."""
    rng = np.random.default_rng(5)
    for length in (3, 12):
        family, least, n = S.LevelFamily(length), {}, 0
        for i in range(60):
            text = rng.integers(0, 2, int(rng.integers(length, 90)), dtype=np.uint8) * 97
            starts = np.arange(len(text) - length + 1)
            ids = np.sort(rng.integers(10 * i, 10 * i + 12, len(starts)))[rng.permutation(len(starts))] if i else np.zeros(len(starts), int)
            ids = np.maximum(ids, n)
            n = int(ids.max())
            strings = [text[p : p + length].tobytes() for p in starts.tolist()]
            for s, k in zip(strings, ids.tolist(), strict=True):
                least[s] = min(k, least.get(s, k))
            assert family.add(text, starts, ids).tolist() == [least[s] < k for s, k in zip(strings, ids.tolist(), strict=True)]
            family = S.LevelFamily.load(family.dump(), length) if i % 7 == 3 else family
        sizes = [len(x) for x in family.levels]
        assert sum(sizes) == len(least) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        for level in family.levels:
            keys = level.keys(0, len(level))
            assert (keys[1:] > keys[:-1]).all() and all(least[bytes(k).ljust(length, b"\0")] == i for k, i in zip(keys, level.ids.tolist(), strict=True))


def test_more_blocks_than_hash_reducers_and_rows_wholly_alike(spark, monkeypatch):
    """Blocks and the reducers of hashes differ in number; a third of the rows are one row many times."""
    monkeypatch.setattr(S, "BLOCK", 1500)
    rows = rows_of(11)
    rows += [rows[40]] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert -(-sum(len((t or "").encode()) for _, t in rows) // S.BLOCK) > 8
    got = sorted((tuple(r) for r in S.suffix_dedup(df, S._Digest(), ["doc_id"]).collect()), key=str)
    assert got == brute(rows)
