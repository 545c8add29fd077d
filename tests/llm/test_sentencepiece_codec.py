"""Against the library itself, over awkward texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from factloom.llm import sentencepiece_codec as C

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", " ", "  ", "a  b ", "\n", "\n\n x", "x\n y\n", "▁x ▁", " lead", "tab\tand\x00nul", "naïve café — ½ €😀", "日本語 テスト", "\n▁\n ▁", "word" * 300, "é" * 50 + " " * 20 + "end", "<s> </s> <unk>", "​﻿x", "a\r\nb"]


def texts_of(seed):
    rng = random.Random(seed)
    alphabet = "abcdeTHE  \n\n▁é日😀\t.,0123'"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]


def test_ids_decode_and_spans():
    codec = C.Codec(PATH)
    assert codec.by_segment
    texts = texts_of(1)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t, (ids, widths, decimal) in zip(texts, codec.encode(texts)):
        want = library.encode(t)
        assert ids.tolist() == want and decimal == ",".join(map(str, want)) and codec.decode(ids) == library.decode(want)
        raw = t.encode()
        starts, ends = codec.spans(raw, widths)
        proto = library.encode(t, return_type="proto").pieces
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto]
        assert (len(starts) == 0 and not raw) or (starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all())


def test_compiled_map_against_the_library():
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        model = library.serialized_model_proto()
        spec = next(v for n, v in C._fields(model) if n == 3)
        own = C.Normalizer(spec, [])
        own.identity = False
        for t in [*texts_of(2), "ﬁne ＡＢＣ ①② Å ｶﾞ ㍿ Ⅷ", " wide　space​!", "ÀÉ ß ẞ İ"]:
            raw = t.encode()
            body, align = own(raw)
            want, offsets = library.normalize(t, with_offsets=True)
            assert body.decode() == want
            heads = [i for i, c in enumerate(body) if c & 0xC0 != 0x80] + [len(body)]
            assert [len(raw[: align[i]].decode()) for i in heads] == list(offsets)


def test_other_models_go_whole():
    codec = C.Codec(PATH)
    codec.by_segment = False
    for t, (ids, widths, _) in zip(TEXTS, codec.encode(TEXTS)):
        assert ids.tolist() == codec.library.encode(t)
        assert codec.spans(t.encode(), widths)[0].shape == ids.shape


def test_frames(spark):
    texts = [*TEXTS, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "again", "y")], "doc_id long, text string, ids string").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(e), sha(",".join(map(str, e))), sha(library.decode(e)), len((t or "").encode())) for i, t in [*enumerate(texts), (0, "again")] for e in [library.encode(t or "")])
    assert sorted(tuple(r) for r in C.digests(df).collect()) == want
    back = C.decode(C.encode(df)).where("doc_id > 0").collect()
    assert all(r["decoded"] == library.decode(r["ids"]) for r in back) and len(back) == len(texts) - 1
    assert C.digests(df.where("doc_id < 0")).count() == 0
