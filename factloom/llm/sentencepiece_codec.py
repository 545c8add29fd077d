"""Offset-preserving SentencePiece encoding, and decoding.

Normalisation is done here, by longest prefixes through the model's compiled character map (a double-array
trie over bytes), and records for each normalised byte where in the original text it came from.  The pieces
that the library finds then project to spans of original bytes: piece i covers
``align[end of the pieces before it] : align[its own end]``.

Speed comes from the normalised text's segments: in a model none of whose pieces has a space mark after
another character, or a line feed among others, no merge reaches over such a border, so a segment's pieces do
not depend on its neighbours.  A worker keeps the pieces of the segments that it has met, up to a bound, and
asks the library for the rest.  ``Codec`` checks the model for this and otherwise encodes whole texts.

Defined results: null is the empty text, which has no ids; decoding gives the library's ``decode(ids)``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Kinds of pieces in a model file that matter here.
USER_DEFINED, BYTE = 4, 6
#: Segments that a worker keeps, and bytes of them with what Python adds; it forgets all of them beyond either.
CACHED, CACHED_BYTES = 300_000, 128 << 20
SLICE = 4 << 20
_SEGMENT = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n+")

_codecs: dict[str, Codec] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: bytes 0-3 give the trie's size, then its units, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at a place, and what replaces it."""
        if not self.units:
            return None
        best = None
        node = self._child(0, self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:  # a value is stored below
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1] : end]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))


class Normalizer:
    """Text -> normalised bytes, and for each of them (and the end) a place in the original bytes."""

    def __init__(self, spec: bytes, user_defined: list[str]) -> None:
        f = dict(_fields(spec))
        self.map = CharacterMap(f.get(2) or b"")
        self.dummy, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        self.symbols = sorted((s.encode() for s in user_defined), key=len, reverse=True)
        self.identity = not self.map.units and not self.squeeze and self.escape and not self.symbols

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for s in self.symbols:
            if text.startswith(s, at):
                return len(s), s
        found = self.map.longest(text, at)
        if found:
            return found
        n = 1
        while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
            n += 1
        return n, text[at : at + n]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if self.identity:
            return self._plain(text)
        space = SPACE.encode() if self.escape else b" "
        out, places, at = [], [], 0
        if self.squeeze:
            while at < len(text):
                n, put = self._prefix(text, at)
                if put.strip(b" "):
                    break
                at += n
        if at >= len(text):
            return b"", np.zeros(1, np.int64)
        if self.dummy:
            out.append(space)
            places += [at] * len(space)
        after_space = self.squeeze
        while at < len(text):
            n, put = self._prefix(text, at)
            while after_space and put.startswith(b" "):
                put = put[1:]
            if put:
                for c in re.findall(rb" |[^ ]+", put):
                    c = space if c == b" " else c
                    out.append(c)
                    places += [at] * len(c)
                after_space = self.squeeze and put.endswith(b" ")
            elif not n:
                break
            at += n
            if not self.squeeze:
                after_space = False
        body = b"".join(out)
        if self.squeeze:
            while body.endswith(space):
                body = body[: -len(space)]
                at = places[len(body)]
                places = places[: len(body)]
        return body, np.array([*places, at])

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no squeezing: only spaces change, so the alignment is one vector operation."""
        if not text:
            return b"", np.zeros(1, np.int64)
        mark = SPACE.encode()
        raw = np.frombuffer(text, np.uint8)
        at = np.arange(len(raw))
        head = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, at, 0))  # a character's bytes share its start
        places = np.repeat(head, np.where(raw == 32, 3, 1))
        body = text.replace(b" ", mark)
        front = np.zeros(3 if self.dummy else 0, np.int64)
        return (mark if self.dummy else b"") + body, np.concatenate([front, places, [len(raw)]])


class Codec:
    """A model's encoder and decoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for n, v in fields if n == 1]
        kinds = [p.get(3, 1) for p in pieces]
        names = [p[1].decode() for p in pieces]
        spec = next((v for n, v in fields if n == 3), b"")
        self.normalizer = Normalizer(spec, [s for s, k in zip(names, kinds, strict=True) if k == USER_DEFINED])
        self.widths = [1 if k == BYTE else len(s.encode()) for s, k in zip(names, kinds, strict=True)]
        inner = any(SPACE in s.lstrip(SPACE) or "\n" in s for s in names)
        self.by_segment = self.normalizer.identity and self.normalizer.dummy and not inner and kinds.count(BYTE) == 256 and len(pieces) < 1 << 16
        self.known: dict[str, tuple[str, bytes, bytes]] = {}
        self.held = 0

    @staticmethod
    def of(path: str) -> Codec:
        if path not in _codecs:
            _codecs[path] = Codec(path)
        return _codecs[path]

    def _learn(self, fresh: list[str]) -> None:
        # Segments start with a space, which the library's own dummy prefix then is; or else a line feed goes
        # before them, and its two pieces off again.  One space alone would be the empty text.
        asked = ["\n" if s == " " else s[1:] if s[0] == " " else "\n" + s for s in fresh]
        for s, ids in zip(fresh, self.library.encode(asked, num_threads=1), strict=True):
            ids = ids[:1] if s == " " else ids if s[0] == " " else ids[2:]
            width = [self.widths[i] for i in ids]
            self.known[s] = ",".join(map(str, ids)), np.array(ids, "<u2").tobytes(), np.array(width, "<u2").tobytes()
            self.held += 350 + len(s) + 9 * len(ids)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """For each text: ids, the pieces' widths in normalised bytes, and the ids in decimal with commas."""
        if not self.by_segment:
            for text, found in zip(texts, self.library.encode(texts, return_type="proto", num_threads=1), strict=True):
                ids = [p.id for p in found.pieces]
                width = [1 if self.library.is_byte(p.id) else len(p.piece.encode()) for p in found.pieces]
                yield np.array(ids, np.int64), np.array(width, np.int64), ",".join(map(str, ids))
            return
        # A space mark in the text is a space to the model.
        cut = [_SEGMENT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > CACHED or self.held > CACHED_BYTES:
            self.known, self.held = {}, 0
        fresh = list({s for own in cut for s in own if s not in self.known})
        for at in range(0, len(fresh), 20_000):
            self._learn(fresh[at : at + 20_000])
        get = self.known.__getitem__
        for own in cut:
            found = [get(s) for s in own]
            ids = np.frombuffer(b"".join([x[1] for x in found]), "<u2")
            yield ids, np.frombuffer(b"".join([x[2] for x in found]), "<u2"), ",".join([x[0] for x in found])

    def spans(self, text: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original bytes [start, end) of each piece."""
        body, align = self.normalizer(text)
        ends = np.cumsum(widths, dtype=np.int64)
        if (int(ends[-1]) if len(ends) else 0) != len(body):
            raise ValueError("pieces do not add up to the normalised text")
        edge = align[np.r_[0, ends]]
        return edge[:-1], edge[1:]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return model


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """The batch's texts in slices of bounded size."""
    texts, at, size = batch.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i + 1 == len(texts):
            yield at, [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, model: str | None = None) -> DataFrame:
    """(key, ids, starts, ends) of every row: the pieces' ids and the original bytes that each covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(_path(model))
        for batch in batches:
            for at, texts in _texts(batch):
                cols: list[list] = [[], [], []]
                for t, (ids, widths, _) in zip(texts, codec.encode(texts), strict=True):
                    for col, x in zip(cols, (ids.astype(np.int32), *codec.spans(t.encode(), widths)), strict=True):
                        col.append(x)
                kinds = [pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *[pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds, strict=True)]], [key, "ids", "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, ids: str = "ids", *, model: str | None = None, name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        codec = Codec.of(_path(model))
        return pa.array([None if x is None else codec.library.decode(x) for x in column.to_pylist()], pa.string())

    return encoded.withColumn(name, of(F.col(ids)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", *, model: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, covered_bytes): what ``encode`` and ``decode`` give, without
    moving the ids; covered_bytes adds up the pieces' spans and so equals the text's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(_path(model))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at, texts in _texts(batch):
                rows = []
                for t, (ids, widths, decimal) in zip(texts, codec.encode(texts), strict=True):
                    starts, ends = codec.spans(t.encode(), widths)
                    rows.append((len(ids), sha(decimal), sha(codec.decode(ids)), int((ends - starts).sum())))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    return digests(table(spark, sf_dir, "documents"))
