"""The whole pipeline on the smallest tables against plain Python, stage by stage."""

import re
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import quality as Q
from factloom.llm import secrets as S
from llm.test_quality import bins_of, plain
from llm.test_near_copies import slow_keep

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]", t) if w]


def good(docs, labels):
    trusted = {i for i, q in labels if q == 1}
    bins = {i: bins_of(words(t)) for i, t, _ in docs}
    raw, target = Counter(), Counter()
    for i, own in bins.items():
        raw.update(own)
        if i in trusted:
            target.update(own)
    r, t = sum(raw.values()), sum(target.values())
    prior = Q.PRIOR + Q.PRIOR_GRAMS / t
    weight = {b: log((target[b] * r / (n * t) + prior) / (1 + prior)) for b, n in raw.items()}
    return [d for d in docs if not plain(d[1])[-1] and sum(weight[b] for b in bins[d[0]]) / len(bins[d[0]]) >= Q.THRESHOLD]


def distinct(docs):
    """Similarity 0.8 or more of five-word shingles, by comparing all pairs."""
    kept = set(slow_keep([(i, t) for i, t, _ in docs]))
    return [d for d in docs if d[0] in kept]


def cut(docs):
    first = {}
    for i, t, _ in docs:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t, s in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            out.append((i, left, s))
    return out


def masked(docs):
    owners = defaultdict(set)
    found = {i: S.candidates(t) for i, t, _ in docs}
    for i, _, s in docs:
        for *_, v in found[i]:
            owners[v].add((s, i))
    out = []
    for i, t, s in docs:
        parts, at = [], 0
        for a, _, z, v in found[i]:
            live = len({o for o, _ in owners[v]}) <= S.MOST_OWNERS and len(set(v)) >= S.LEAST_CHARACTERS
            if live and z > at:
                parts += [t[at : max(at, a)], "[secret]"] if a >= at else []
                at = z
        out.append((i, "".join([*parts, t[at:]]), s))
    return out


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs
    for (name, stage), plainly in zip(corpus_pipeline.STAGES, [lambda d: good(d, labels), distinct, cut, masked]):
        frame = stage(spark, frame, SF).persist()
        want = plainly(want)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in frame.collect()) == sorted(want), name
        assert 0 < len(want) < len(docs)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces = []
    for i, t, _ in want:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        pieces += [(i, n, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in last) == sorted(pieces)
    room = defaultdict(int)
    for r in last:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, columns named like inner ones, and tables without rows."""
    good = [" ".join(f"w{(i * 37 + j * j) % 997}" for j in range(80)) for i in range(3)]
    rows = [(1, good[0], "en", "s", 1, "m"), (1, good[0], "en", "s", 1, "m"), (None, good[1], None, None, None, None), (3, None, None, "s", None, "x"), (4, "", "en", None, 0, "y"), (5, good[2], "en", "s", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__mark` string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some, want in ((docs, {1, None, 5}), (docs.limit(0), set())):
        frame = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}{len(want)}")
            frame = spark.read.parquet(f"{tmp_path}/{name}{len(want)}")
            assert frame.columns == docs.columns
        assert {r["doc_id"] for r in frame.collect()} == want and frame.count() == len(want)
        assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()} == want
