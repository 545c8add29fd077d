"""The pipeline's near-duplicates against brute force over all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from factloom.llm import near_copies as N
from factloom.llm import simhash as S


def slow_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_keep(docs, least=0.8):
    sets = {i: slow_set(t) for i, t in docs}
    parent = {i: i for i in sets}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(i for i in sets if root(i) == i)


def copies(seed, groups=12, most=6):
    """Texts with copies that replace one to six of 100 to 200 words."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = ["w%d" % rng.randrange(2000) for _ in range(rng.randint(100, 200))]
        for j in range(rng.randint(1, most)):
            words = list(base)
            for at in rng.sample(range(len(words)), j):
                words[at] = "x%d" % rng.randrange(2000)
            out.append((len(out), " ".join(words)))
    return out


def test_near_copies_beyond_four_bits_go_and_pairs_below_stay(spark):
    docs = copies(3)
    sets = {i: slow_set(t) for i, t in docs}
    far = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and bin(S.fingerprint(docs[a][1], 5) % (1 << 64) ^ S.fingerprint(docs[b][1], 5) % (1 << 64)).count("1") > S.RADIUS]
    assert far
    got = S.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == slow_keep(docs)


def test_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(r["doc_id"] for r in S.deduplicate(docs).collect()) == slow_keep([tuple(r) for r in docs.collect()])


def test_forest_and_blocks_give_the_same_groups(spark):
    docs = copies(4, 20, 9)
    sets = [N.shingle_set(t, 5) for _, t in docs]
    want = slow_keep(docs)
    parent = list(range(len(docs)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i, j in N.forest(sets, 0.8):
        x, y = sorted((root(i), root(j)))
        assert x != y
        parent[y] = x
    assert [i for i in range(len(docs)) if root(i) == i] == want
    frame = spark.createDataFrame([(0, i, t) for i, t in docs], "root long, node long, text string")
    left = {r["node"] for r in S.components(N.exact_edges(frame, 5, 0.8, 7)).collect()}
    assert sorted(set(range(len(docs))) - left) == want


def test_cells_meet_at_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = np.unique(base[:90]), np.unique(np.r_[base[:80], base[90:]])
        assert set(N.cells_of(a)) & set(N.cells_of(b))


def test_stages_up_to_secrets(spark):
    """``test_pipeline`` with the stage's contract in place of the four bits."""
    import corpus_pipeline
    from llm.test_pipeline import SF, cut, good, masked

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]

    def distinct(docs):
        kept = set(slow_keep([d[:2] for d in docs]))
        return [d for d in docs if d[0] in kept]

    for (name, stage), plainly in zip(corpus_pipeline.STAGES, [lambda d: good(d, labels), distinct, cut, masked]):
        frame = stage(spark, frame, SF).persist()
        want = plainly(want)
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in frame.collect()) == sorted(want), name


def alike(rng, n, least):
    """Two sets of n hashes or fewer, hardly similar enough."""
    b = n - int(rng.integers(0, int(n * (1 - least)) + 1))
    s = int(np.ceil(least * (n + b) / (1 + least) - 1e-9))
    base = np.unique(rng.integers(0, 1 << 63, n + b - min(s, b), dtype=np.uint64) * np.uint64(2))
    return base[:n], np.unique(np.r_[base[: min(s, b)], base[n:]])


def test_cells_are_bands_of_popcounts_at_distance_zero():
    """Two sets share just those cells in whose bands their popcounts are the same and full, counted plainly."""
    rng = np.random.default_rng(7)
    met = 0
    for n in (5, 9, 30, 100, 700):
        for _ in range(10):
            x, y = alike(rng, n, 0.8)
            want = 0
            tops = N._tops(0.8)
            levels = [{i, i + 1} for i in (next(k for k, top in enumerate(tops) if len(z) <= top) for z in (x, y))]
            for i in levels[0] & levels[1]:
                if N._level(i, 0.8) is None:
                    continue
                m, bands, full = N._level(i, 0.8)
                counts = []
                for z in (x, y):
                    own = {}
                    for band in range(bands):
                        deal = band // m
                        places = [(int(h) * int(N._TIMES[deal]) + int(N._PLUS[deal])) % (1 << 64) for h in z]
                        own[band] = sorted(p >> 16 for p in places if (p >> 32) * m >> 32 == band % m)
                    counts.append(own)
                want += sum(counts[0][b] == counts[1][b] and len(counts[0][b]) >= full for b in range(bands))
            assert len(set(N.cells_of(x)) & set(N.cells_of(y))) == want > 0
            met += want
    assert met


def test_cells_meet_at_any_bound():
    rng = np.random.default_rng(8)
    for least in (0.6, 0.8, 0.9):
        for n in (6, 20, 60, 250):
            for _ in range(150):
                x, y = alike(rng, n, least)
                if len(x) != len(y) or (x != y).any():
                    assert set(N.cells_of(x, least)) & set(N.cells_of(y, least)), (least, n)


def test_manhattan_distance_is_tested_first_and_loses_nothing():
    docs = copies(9, 25, 7)
    sets = [N.shingle_set(t, 5) for _, t in docs]
    for least in (0.5, 0.8):
        parent = list(range(len(docs)))
        root = lambda i: i if parent[i] == i else root(parent[i])  # noqa: B023, E731
        for i, j in N.forest(sets, least):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
        assert [i for i in range(len(docs)) if root(i) == i] == slow_keep(docs, least)


def test_a_worker_holds_the_cells_of_a_batch_as_plain_numbers():
    texts = [t for _, t in copies(6, 60, 9)] + [None, "", " \n", "a b"]
    tracemalloc.start()
    got = N._nodes(pa.array(texts, pa.string()), 5, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sets = [N.shingle_set(t, 5) for t in texts]
    want = [N.cells_of(s, 0.8) for s in sets]
    assert got.field("node").to_pylist() == [N.node_of(s) for s in sets] and got.field("cells").to_pylist() == want
    # As Python numbers each took 40 bytes.
    assert most < 24 * sum(map(len, want)) + 500_000
    assert N._nodes(pa.array([], pa.string()), 5, 0.8).type == got.type
