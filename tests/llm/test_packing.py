"""Round trips, and the plan against exhaustive search and the volume bound."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from factloom.llm import packing as P

TEXTS = ["It's a TEST, isn't it?", "", None, "a b\tc\r\nd  e", "Ínes ́x İSTANBUL ΣΑΣ", "<|endoftext|> and <|startoftext|>x", "x y\x1cz 123456", "é ̈́́", "word " * 9000, "naïve café — ½ €", " \n\t "]


def ids_of(text):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_and_places(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "x y"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.packed_pieces(df).collect()
    want = []
    for i, t in rows:
        ids = ids_of(t)
        want += [(i, n, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in P.sequences(df).collect():
        for p in r["parts"]:
            assert r["ids"][p["offset"] : p["offset"] + p["length"]] == ids_of(TEXTS[p["key"]])[p["start"] : p["start"] + p["length"]]
    assert P.sequences(df.where("doc_id < 0")).count() == 0


def best(sizes, capacity):
    """Fewest bins, by search over bins' contents."""
    sizes = sorted(sizes, reverse=True)
    for k in range(-(-sum(sizes) // capacity), len(sizes) + 1):
        seen = set()

        def fit(i, rooms):
            if i == len(sizes):
                return True
            if (i, rooms) in seen:
                return False
            seen.add((i, rooms))
            return any(fit(i + 1, tuple(sorted((*rooms[:j], r - sizes[i], *rooms[j + 1 :])))) for j, r in enumerate(rooms) if r >= sizes[i] and (j == 0 or rooms[j - 1] != r))

        if fit(0, (capacity,) * k):
            return k
    return 0


def check(count, capacity):
    patterns = P.plan(count, capacity)
    held = np.zeros_like(count)
    for parts, copies in patterns:
        assert copies > 0 and 0 < sum(n * k for n, k in parts.items()) <= capacity
        for n, k in parts.items():
            held[n] += k * copies
    assert (held == count).all()
    return sum(c for _, c in patterns)


def test_plan():
    rng = random.Random(1)
    off = 0
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
        least = best(sizes, 20)
        got = check(np.bincount(sizes, minlength=21), 20)
        assert least <= got <= least + 1
        off += got - least
    assert off <= 8


def test_reduction_is_safe():
    """What is fixed leaves an instance whose best packing is no worse in total."""
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.randint(3, 20) for _ in range(rng.randint(1, 10))]
        count = np.bincount(sizes, minlength=21)
        fixed = P._reduce(count, 20)
        rest = list(itertools.chain.from_iterable([n] * int(k) for n, k in enumerate(count)))
        assert sum(c for _, c in fixed) + best(rest, 20) == best(sizes, 20)


def test_large_counts_near_the_volume_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 200_000).astype(int) + 1)
    count = np.bincount(lengths, minlength=4097) * 1_000_000
    assert check(count, 4096) <= 1.001 * -(-(count * np.arange(4097)).sum() // 4096)


class Counted:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def whole(texts):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def encoded(texts):
    """Ids of each text, and how many texts the tokenizer itself got for them."""
    encoder = P.ChunkEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    bodies = [b for _, some in P._slices(pa.array(texts, pa.string()), 1 << 12) for b in encoder.encode(some)]
    return [np.frombuffer(b, "<u4").tolist() for b in bodies], counted.texts


def test_many_chunks_are_encoded_as_one_text():
    texts = [" ".join(f"w{i}x{j}é" if j % 3 else f"w{i}x{j}'s," for j in range(50)) for i in range(200)]
    got, calls = encoded(texts)
    assert got == whole(texts)
    assert calls < 400


def test_chunks_with_the_mark_and_other_odd_ones():
    odd = ["~", "é~", "~é ~ ~~ é", "é ~ ü", "</w> é</w>", "photography", "\x85 é\x85~ a", "a\x00b \x1c\x1d \x7fé", "<| ~ <|endoftext|>~ é<|startoftext|>", "' 's '' é's", "́ é~ ́", "\v\f~\r\n", "４２ ½~", "  ", "", None]
    assert encoded(odd)[0] == whole(odd)
    rng = random.Random(5)
    parts = ["~", "é", "a", "'s", "7", " ", "\n", "<|", "|>", "́", "&", "İ", "ς", "‍", "\x1f", "</w>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    assert encoded(texts)[0] == whole(texts)


def test_a_worker_of_the_pipeline_keeps_no_encoder(spark, monkeypatch):
    """Steps that follow in the same worker need its memory."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    batch = pa.record_batch({"doc_id": pa.array(range(len(TEXTS))), "text": pa.array(TEXTS, pa.string())})
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, ddl: run)
    for cached, kept in ((P.CACHED_BYTES, 0), (P.CACHED_ALONE, 1)):
        monkeypatch.setattr(P, "_encoders", {})
        assert sum(b.num_rows for b in P.token_pieces(docs, cached=cached)(iter([batch, batch]))) >= 2 * len(TEXTS)
        assert len(P._encoders) == kept
