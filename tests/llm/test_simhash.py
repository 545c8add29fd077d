"""Against brute force over all pairs."""

import os
import random
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash as S
from factloom.llm.common import checkpoint_folder, sweep


def slow_print(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in "\t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, radius=4):
    parent = {f: f for f in prints}
    root = lambda f: f if parent[f] == f else root(parent[f])
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= radius:
                parent[root(a)] = root(b)
    return {f: root(f) for f in prints}


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ünï", "ÀB", "x y", "K"]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 40, 200]))]
        for j in range(rng.choice([1, 1, 2, 6])):
            words = [rng.choice(vocabulary) if rng.random() < 0.01 * j else w for w in base]
            rows.append((len(rows) * 3 % 500, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "A b C d"), (904, "a B c D"), (None, "a b c d"), (None, None), (None, "alone here now then gone")]
    return rows


def test_fingerprint_and_spark_hash(spark):
    rows = rows_of(1)
    for _, t in rows:
        assert S.fingerprint(t, 4) % (1 << 64) == slow_print(t, 4)
    got = spark.sql("select xxhash64('a b c d')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def check(spark, rows, found):
    prints = {t: slow_print(t, 4) for _, t in rows}
    groups = slow_groups(set(prints.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[groups[prints[t]]] = min(i, least.get(groups[prints[t]], i))
    want = sorted(((i, prints[t], least.get(groups[prints[t]])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["__fp"] % (1 << 64), r["__component"]) for r in found.collect()), key=str) == want


def test_groups(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(spark, rows, S.near_duplicates(df, width=4))


def test_crowded_cells_give_the_same_components(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 20, dtype=np.int64)
    flips = [int(b) ^ int(np.int64(1) << np.int64(rng.integers(0, 63))) for b in base for _ in range(30)]
    prints = sorted({*map(int, base), *flips, 0})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = slow_groups({p % (1 << 64) for p in prints})
    parts = {}
    for p, r in want.items():
        parts.setdefault(r, set()).add(p)
    for cell in (4, 8192):
        got = {}
        for r in S.components(S.link_forest(df, 4, cell)).collect():
            got.setdefault(r["root"] % (1 << 64), {r["root"] % (1 << 64)}).add(r["node"] % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in parts.values() if len(v) > 1)


def test_bound_and_chain(spark):
    rng = np.random.default_rng(6)
    a, b = (rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64) for _ in range(2))
    hamming = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))
    assert (np.bitwise_count(S.embed(a) ^ S.embed(b)) <= hamming).all()
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)}


def test_deduplicate(spark):
    rows = [(3, "a b c d e f", "p"), (1, "a b c d e f", "q"), (2, "other words stand here now", "r"), (2, "other words stand here now", "r"), (None, "third text with five words", "s"), (None, "a b c d e f", "t"), (4, None, "u"), (5, "", "v")]
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, __x string")).collect()
    assert sorted((r["doc_id"], r["__x"]) for r in got if r["doc_id"]) == [(1, "q"), (2, "r"), (4, "u")] and [r["__x"] for r in got if r["doc_id"] is None] == ["s"]
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_edges_are_settled_without_rounds(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(190)] + [(-5, 7), (2000, 2000)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = len(os.listdir(folder))
    got = {r["node"]: r["root"] for r in S.components(edges).collect()}
    assert len(os.listdir(folder)) - before == 2  # the edges and the result; rounds write two more each
    assert got == {x: r for x, r in root.items() if x != r}
    assert {r["node"]: r["root"] for r in S.components(edges, few=0).collect()} == got
    assert {r["node"]: r["root"] for r in S.components(edges, few=350).collect()} == got
    assert not S.components(edges.limit(0)).collect()


def test_sweep_removes_shuffle_files_of_frames_that_are_gone(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    df = spark.range(1000).repartition(9)
    assert df.count() == 1000
    had = files()
    del df
    sweep(spark)
    for _ in range(50):
        if files() < had:
            break
        time.sleep(0.1)
    assert files() < had
