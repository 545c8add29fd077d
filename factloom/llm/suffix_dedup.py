"""Suffix-array de-duplication of byte passages with a logarithmic family of indexes.

A byte goes if some ``length``-byte string (50) over it also starts in a document with a smaller id.  The
strings of a document are compared as suffixes cut at 50 bytes:

* ``LevelFamily`` is the index.  A new batch of texts, all from ids not smaller than those before, gets
  its suffix array (starts of the suffixes in their order, with the smallest id of each), is merge-scanned
  against every existing level for equal 50-byte prefixes, and becomes a level itself; levels of about equal
  size merge, so there are O(log n) of them and each suffix is merged O(log n) times.  A family can be stored
  (``dump``, ``load``) and take further batches.
* To run many families side by side, suffixes are dealt out by the smallest hash among the 20-byte grams
  inside their 50 bytes (a minimizer).  Equal strings have equal minimizers, so no match is lost, and
  neighbouring suffixes mostly share one: a run of them travels as one segment of some 66 bytes.

Stages, each keyed so that no task holds an unbounded group:

1. Documents are dealt into blocks of bounded size; a block emits the distinct minimizer hashes it holds,
   with an id range for each (8 to 24 bytes a hash, packed per reducer).
2. Reducers return to each block which of its hashes another document shares.  A hash is there once a
   block at most, however many rows hold it.
3. Blocks emit the segments of shared hashes, each distinct content once, for the smallest id in the block
   that holds it; the block's larger ids are covered at once.  A hash that very many blocks hold sends its
   50-byte strings by their own hash instead, so common passages with many different contexts spread.
4. Reducers run a ``LevelFamily`` in id order and return the covered intervals to the blocks.
5. Blocks merge the intervals and cut.

The blocks' exchange is the same in 1, 3 and 5, so the text is shuffled once.  Hashes only choose what is
compared: every removal rests on equal bytes.  A block packs what it sends to a reducer into one row, so the rows
between stages never outnumber the hashes and segments in them, which grow in proportion to the text; reducers of
stage 2 are fewer than blocks.

Defined results: null text is empty; a null id neither covers nor is covered; rows with the same id do not
cover each other, whether their texts are equal or not; texts of any length are read in overlapping chunks; empty tables
give empty results; extra columns, whatever their names, pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, shuffle_partitions, table, tidy, unpacked

LENGTH = 50
GRAM = 20
#: Bytes of text handled at once inside a block, and of a block.
CHUNK = 1 << 19
BLOCK = 8 << 20
#: Bytes of text whose hashes one reducer of stage 2 holds; a hash and what goes with it take about a byte of these.
HASHED = 32 << 20
#: Segments per batch of a level family.
BATCH = 100_000
#: Blocks that must hold a hash before its strings are dealt out by themselves.
COMMON = 4096
#: Blocks that rows alike in key and text are dealt over, at most.
SPREAD = 64

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier modulo 2**64, and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 2 * CHUNK)
        out = []
        for base in (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers


def _window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes: differences of one running sum, scaled back and mixed."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[width:] - total[: n + 1 - width]) * inverse[: n + 1 - width]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: -(width - span)], a[width - span :]) if width > span else a


def _chunks(texts: list[memoryview], length: int) -> Iterator[tuple[list[tuple[int, int, int, int]], np.ndarray]]:
    """(pieces, bytes): a piece is (row, start in the row, start in the bytes, length).  Long rows come in
    pieces that overlap by length - 1 bytes, so every string lies in exactly one piece."""
    pieces: list[tuple[int, int, int, int]] = []
    parts: list[memoryview] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            n = min(len(text) - at, CHUNK + length - 1)
            pieces.append((row, at, size, n))
            parts.append(text[at : at + n])
            size += n
            at += n - length + 1
            if size >= CHUNK:
                yield pieces, np.frombuffer(b"".join(parts), np.uint8)
                pieces, parts, size = [], [], 0
    if pieces:
        yield pieces, np.frombuffer(b"".join(parts), np.uint8)


def _runs(pieces: list, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one minimizer: hash, row, start in row, start in data, strings."""
    low = _sliding_min(_window_hashes(data, gram), length - gram + 1)
    n = len(low)
    starts = np.array([p[2] for p in pieces])
    fit = np.array([p[3] - length + 1 for p in pieces])
    at = np.arange(n)
    piece = np.repeat(np.arange(len(pieces)), np.diff(np.r_[starts, len(data)]))[:n]
    inside = at - starts[piece] < fit[piece]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (piece[1:] != piece[:-1])
    edge = np.flatnonzero(new & inside)
    # A run ends where the next begins or its piece's last string is.
    last = starts[piece[edge]] + fit[piece[edge]]
    count = np.minimum(np.r_[edge[1:], n], last) - edge
    rows = np.array([p[0] for p in pieces])[piece[edge]]
    offset = np.array([p[1] - p[2] for p in pieces])[piece[edge]] + edge
    # Minima are small numbers: mixed again, so that they spread over the reducers.
    least = low[edge]
    return (least ^ (least >> np.uint64(29))) * _MULTIPLIER, rows, offset, edge, count


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a.dtype.char.encode() + np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, kind = int.from_bytes(blob[at : at + 8], "little"), np.dtype(chr(blob[at + 8]))
        out.append(np.frombuffer(blob, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


def _strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length``-byte strings of the text that start there."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at]).view(f"S{length}").ravel()


def _heads(keys: np.ndarray) -> np.ndarray:
    """The first eight bytes of each string as a number, in the order of the strings."""
    eight = np.zeros((len(keys), 8), np.uint8)
    eight[:, : keys.itemsize] = keys.view(np.uint8).reshape(len(keys), -1)[:, :8]
    return eight.view(">u8").ravel().astype(np.uint64)


class SuffixArray:
    """A level: a text, the starts of its distinct suffixes (as far as ``length`` bytes) in their order, the first
    eight bytes of each, and the smallest id that holds it.  About 20 bytes a suffix beside the text."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, heads: np.ndarray, ids: np.ndarray, length: int) -> None:
        self.text, self.heads, self.ids, self.length = text, heads, ids, length
        self.starts = starts.astype(np.uint32 if len(text) < 1 << 32 else np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self, a: int, z: int) -> np.ndarray:
        return _strings(self.text, self.starts[a:z], self.length)

    def place(self, keys: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each string stands or would stand, and whether it does; eight bytes first, then halving."""
        low, high = np.searchsorted(self.heads, heads, "left"), np.searchsorted(self.heads, heads, "right")
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = _strings(self.text, self.starts[middle], self.length) < keys[todo]
            low[todo[less]], high[todo[~less]] = middle[less] + 1, middle[~less]
            todo = todo[low[todo] < high[todo]]
        same = np.zeros(len(keys), bool)
        some = np.flatnonzero(low < len(self))
        some = some[self.heads[low[some]] == heads[some]]
        same[some] = _strings(self.text, self.starts[low[some]], self.length) == keys[some]
        return low, same

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both levels as one; they have no string in common."""
        at = [self.place(other.keys(a, a + BATCH), other.heads[a : a + BATCH])[0] for a in range(0, len(other), BATCH)]
        at = np.concatenate(at)
        starts = np.insert(self.starts.astype(np.int64), at, other.starts.astype(np.int64) + len(self.text))
        text = np.concatenate([self.text, other.text])
        return SuffixArray(text, starts, np.insert(self.heads, at, other.heads), np.insert(self.ids, at, other.ids), self.length)


class LevelFamily:
    """Suffix arrays of geometrically growing size, each suffix with its smallest id."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[SuffixArray] = []

    def add(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each of the text's strings, whether a smaller id holds it too.  Ids must not be below those added
        before."""
        if not len(starts):
            return np.zeros(0, bool)
        keys = _strings(text, starts, self.length)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], ids[order]
        first = np.empty(len(keys), bool)
        first[:1] = True
        first[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(first) - 1
        suffixes, smallest = keys[first], np.minimum.reduceat(owners, np.flatnonzero(first))
        heads = _heads(suffixes)
        fresh = np.ones(len(suffixes), bool)
        for level in self.levels:  # merge-scan; a string is in one level only
            todo = np.flatnonzero(fresh)
            at, same = level.place(suffixes[todo], heads[todo])
            met = todo[same]
            fresh[met] = False
            smallest[met] = np.minimum(smallest[met], level.ids[at[same]])
        if fresh.any():
            self._push(SuffixArray(text, starts[order][first][fresh], heads[fresh], smallest[fresh], self.length))
        out = np.empty(len(keys), bool)
        out[order] = smallest[group] < owners
        return out

    def _push(self, level: SuffixArray) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(level):
            level = self.levels.pop().merged(level)
        self.levels.append(level)

    def dump(self) -> bytes:
        """The levels, for ``load``: later batches of larger ids may join a stored family."""
        return b"".join(len(part).to_bytes(8, "little") + part for x in self.levels if (part := _packed(x.text, x.starts, x.heads, x.ids)))

    @staticmethod
    def load(blob: bytes, length: int = LENGTH) -> LevelFamily:
        out, at = LevelFamily(length), 0
        while at < len(blob):
            n = int.from_bytes(blob[at : at + 8], "little")
            text, starts, heads, ids = _unpacked(blob[at + 8 : at + 8 + n])
            out.levels.append(SuffixArray(text, starts, heads, ids, length))
            at += 8 + n
        return out


def _rows_of(batch: pa.Table, keys: tuple[str, str], text: str) -> tuple[list[memoryview], np.ndarray, np.ndarray, np.ndarray]:
    """Texts, ids and hashes of the block's distinct (id, text) in an order that any retry repeats, and
    each row's place among them.  Rows with a null id are left out (place -1)."""
    ids, marks = (batch.column(k).to_numpy() for k in keys)
    ids = batch.column(keys[0]).fill_null(0).to_numpy().astype(np.int64)
    null = batch.column(keys[0]).is_null().to_numpy()
    order = np.lexsort((marks, ids))
    order = order[~null[order]]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])
    place = np.full(len(ids), -1)
    place[order] = np.cumsum(new) - 1
    some = order[new]
    bodies = batch.column(text).cast(pa.large_binary()).combine_chunks()
    bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
    at, raw = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset :], memoryview(bodies.buffers()[2] or b"")
    return [raw[at[i] : at[i + 1]] for i in some.tolist()], ids[some], marks[some], place


def _split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) over the keys' upper halves."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def _hashes_of_block(keys: tuple[str, str], text: str, buckets: int, length: int, gram: int) -> Callable:
    """Stage 1: a row for each reducer with the block's distinct hashes and their smallest and largest id."""

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        block = key[0].as_py()
        texts, ids, _, _ = _rows_of(batch, keys, text)
        hashes, low, high = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pieces, data in _chunks(texts, length):
            h, rows, *_ = _runs(pieces, data, length, gram)
            own = ids[rows]
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            hashes.append(h[at])
            low.append(np.minimum.reduceat(own, at))
            high.append(np.maximum.reduceat(own, at))
        h, a, z = map(np.concatenate, (hashes, low, high))
        if not len(h):
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        order = np.argsort(h, kind="stable")
        h, a, z = h[order], a[order], z[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        h, a, z = h[at], np.minimum.reduceat(a, at), np.maximum.reduceat(z, at)
        out = []
        for b, own in _split(h, buckets):
            # The low half suffices beside the bucket: a false meeting only costs a comparison.
            first = int(a[own].min())
            far = a[own] - first
            many = np.flatnonzero(a[own] != z[own])
            out.append((b, block, _packed(h[own].astype(np.uint32), np.array([first]), far.astype(np.uint32) if far.max() < 1 << 32 else far, many.astype(np.uint32))))
        cols = list(zip(*out, strict=True))
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), "body": pa.array(cols[2], pa.binary())})

    return run


def _shared(key: tuple, batch: pa.Table) -> pa.Table:
    """Stage 2: back to each block, which of its hashes (by place in what it sent) two ids or more hold."""
    blocks = batch.column("block").to_pylist()
    sent = [_unpacked(x) for x in batch.column("body").to_pylist()]
    h = np.concatenate([s[0] for s in sent])
    ids = np.concatenate([s[1][0] + s[2].astype(np.int64) for s in sent])
    size = np.array([len(s[0]) for s in sent])
    base = np.cumsum(size) - size
    several = np.zeros(len(h), bool)
    for s, b in zip(sent, base, strict=True):
        several[b + s[3].astype(np.int64)] = True
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(h)]))
    low, high = np.minimum.reduceat(ids[order], at), np.maximum.reduceat(ids[order], at)
    hit = (low < high) | np.logical_or.reduceat(several[order], at)
    many = np.diff(np.r_[at, len(h)]) >= COMMON
    flags, common = np.zeros(len(h), bool), np.zeros(len(h), bool)
    flags[order], common[order] = hit[group], (hit & many)[group]
    out = [(b, key[0].as_py(), _packed(h[i : i + n][flags[i : i + n]], common[i : i + n][flags[i : i + n]])) for b, i, n in zip(blocks, base, size, strict=True)]
    cols = list(zip(*out, strict=True))
    return pa.table({"block": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "body": pa.array(cols[2], pa.binary())})


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _segments_of_block(keys: tuple[str, str], text: str, buckets: int, length: int, gram: int, hash_buckets: int | None = None) -> Callable:
    """Stage 3: segments with shared hashes for the reducers, and what the block can settle itself.  ``hash_buckets``:
    the number of stage 2, where it differs."""
    hash_buckets = hash_buckets or buckets
    import zstandard

    def run(key: tuple, docs: pa.Table, flags: pa.Table) -> pa.Table:
        empty = {"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "body": pa.array([], pa.binary())}
        if not docs.num_rows or not flags.num_rows:
            return pa.table(empty)
        block = key[0].as_py()
        texts, ids, _, _ = _rows_of(docs, keys, text)
        found, widely = [], []
        for b, body in zip(flags.column("bucket").to_pylist(), flags.column("body").to_pylist(), strict=True):
            low, common = _unpacked(body)
            found.append((np.uint64(b) << np.uint64(32)) | low)
            widely.append(common)
        shared, common = np.concatenate(found), np.concatenate(widely)
        order = np.argsort(shared)
        shared, common = shared[order], common[order]
        seen: dict[bytes, int] = {}
        held: list[bytes] = []  # distinct segments; then per occurrence: segment, row, start
        least, where, occur = [], [], ([], [], [])
        n_seg = 0
        for pieces, data in _chunks(texts, length):
            h, rows, start, at, count = _runs(pieces, data, length, gram)
            bucket = _bucket(h, buckets)
            mark = (_bucket(h, hash_buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            spot = np.minimum(np.searchsorted(shared, mark), max(0, len(shared) - 1))
            hit = shared[spot] == mark if len(shared) else np.zeros(len(h), bool)
            wide = hit & common[spot] if len(shared) else hit
            if wide.any():  # each string for itself, dealt out by its own hash
                whole = _window_hashes(data, length)
                n = count[wide]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at_w = np.repeat(at[wide], n) + step
                h_w = whole[at_w]
                rest = hit & ~wide
                rows = np.r_[rows[rest], np.repeat(rows[wide], n)]
                start = np.r_[start[rest], np.repeat(start[wide], n) + step]
                bucket = np.r_[bucket[rest], _bucket(h_w, buckets)]
                at, count = np.r_[at[rest], at_w], np.r_[count[rest], np.ones(len(at_w), count.dtype)]
            else:
                rows, start, bucket, at, count = rows[hit], start[hit], bucket[hit], at[hit], count[hit]
            raw = data.tobytes()
            for r, s, b, a, e in zip(rows.tolist(), start.tolist(), bucket.tolist(), at.tolist(), (at + count + length - 1).tolist(), strict=True):
                body = raw[a:e]
                i = seen.setdefault(body, n_seg)
                if i == n_seg:
                    n_seg += 1
                    held.append(body)
                    least.append(ids[r])
                    where.append(b)
                elif ids[r] < least[i]:
                    least[i] = ids[r]
                occur[0].append(i)
                occur[1].append(r)
                occur[2].append(s)
        if not held:
            return pa.table(empty)
        seg, row, pos = (np.array(x, np.int64) for x in occur)
        owner, size, to = np.array(least, np.int64), np.array([len(x) for x in held], np.int64), np.array(where)
        settled = ids[row] > owner[seg]
        # Rows are named by their place among the block's distinct (id, text).
        own = np.flatnonzero(settled)
        out = [(block % buckets, block, b"L" + _packed(row[own].astype(np.uint32), pos[own], pos[own] + size[seg[own]]))] if len(own) else []
        press = zstandard.ZstdCompressor(level=1)
        ask = np.flatnonzero(~settled)
        ask = ask[np.lexsort((seg[ask], to[seg[ask]]))]
        edges = np.searchsorted(to[seg[ask]], np.arange(buckets + 1))
        for b in range(buckets):
            mine = ask[edges[b] : edges[b + 1]]
            if len(mine):
                names, local = np.unique(seg[mine], return_inverse=True)
                meta = _packed(size[names].astype(np.uint32), owner[names], local.astype(np.uint32), row[mine].astype(np.uint32), pos[mine].astype(np.uint32) if pos[mine].max() < 1 << 32 else pos[mine])
                body = len(meta).to_bytes(8, "little") + meta + b"".join([held[i] for i in names.tolist()])
                out.append((b, block, b"S" + press.compress(body)))
        if not out:
            return pa.table(empty)
        cols = list(zip(*out, strict=True))
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), "body": pa.array(cols[2], pa.binary())})

    return run


def _suffixes(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments' text, the starts of all length-byte strings inside them, and the segment of each."""
    size = np.array([len(b) for b in bodies])
    n = size - length + 1
    owner = np.repeat(np.arange(len(bodies)), n)
    starts = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.frombuffer(b"".join(bodies), np.uint8), starts, owner


def _match(length: int) -> Callable:
    """Stage 4: the reducer's level family, in id order; intervals go back to the blocks."""
    import zstandard

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        contents: dict[bytes, int] = {}
        held: list[bytes] = []
        asks = []  # per block: unique segment, id, row, start
        unpress = zstandard.ZstdDecompressor()
        for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if body[:1] == b"L":
                out.append((block, body[1:]))
                continue
            raw = unpress.decompress(body[1:])
            n = int.from_bytes(raw[:8], "little")
            size, owner, local, row, pos = _unpacked(raw[8 : 8 + n])
            ends = (np.cumsum(size.astype(np.int64)) + 8 + n).tolist()
            names = np.empty(len(size), np.int64)
            for j, (e, s) in enumerate(zip(ends, size.tolist(), strict=True)):
                piece = raw[e - s : e]
                i = contents.setdefault(piece, len(held))
                if i == len(held):
                    held.append(piece)
                names[j] = i
            asks.append((block, names, owner, local.astype(np.int64), row, pos.astype(np.int64)))
        if asks:
            names = np.concatenate([a[1] for a in asks])
            owner = np.concatenate([a[2] for a in asks])
            first = np.full(len(held), np.iinfo(np.int64).max)
            np.minimum.at(first, names, owner)
            # Each distinct segment once, for its smallest id: larger ids are covered wholly.
            order = np.argsort(first, kind="stable")
            size = np.array([len(x) for x in held], np.int64)
            covered: list[np.ndarray] = [np.zeros(0, np.int64)] * len(held)
            family = LevelFamily(length)
            for at in range(0, len(order), BATCH // 16):
                some = order[at : at + BATCH // 16]
                body, starts, seg = _suffixes([held[i] for i in some.tolist()], length)
                hit = family.add(body, starts, first[some][seg])
                base = np.searchsorted(seg, np.arange(len(some)))
                if hit.any():
                    # Runs of matching starts within a segment -> [start, end).
                    left = hit & np.r_[True, ~hit[:-1] | (seg[1:] != seg[:-1])]
                    right = hit & np.r_[~hit[1:] | (seg[1:] != seg[:-1]), True]
                    a, z = np.flatnonzero(left), np.flatnonzero(right)
                    mine = seg[a]
                    spans = np.stack([a - base[mine], z - base[mine] + length], 1)
                    cut = np.searchsorted(mine, np.arange(len(some) + 1))
                    for j in np.unique(mine).tolist():
                        covered[int(some[j])] = spans[cut[j] : cut[j + 1]].ravel()
            n_spans = np.array([len(c) // 2 for c in covered])
            flat = np.concatenate([*covered, np.zeros(0, np.int64)])
            begin = np.cumsum(n_spans) - n_spans
            for block, own, owner, local, row, pos in asks:
                seg = own[local]
                whole = owner[local] > first[seg]
                n = np.where(whole, 0, n_spans[seg])
                i = np.repeat(begin[seg], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = np.repeat(pos, n)
                rows = np.r_[row[whole], np.repeat(row, n)]
                if len(rows):
                    out.append((block, _packed(rows, np.r_[pos[whole], p + flat[2 * i]], np.r_[pos[whole] + size[seg[whole]], p + flat[2 * i + 1]])))
        cols = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table({"block": pa.array(cols[0], pa.int32()), "body": pa.array(cols[1], pa.binary())})

    return run


def _cut_block(keys: tuple[str, str], text: str, kept: list[str], finish: Callable) -> Callable:
    """Stage 5: merged intervals per row; ``finish`` makes the result columns from (text, spans)."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        texts, _, _, place = _rows_of(docs, keys, text)
        spans: dict[int, list] = {}
        parts = [_unpacked(b) for b in found.column("body").to_pylist()]
        if parts:
            row, a, z = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(3))
            order = np.lexsort((a, row))
            row, a, z = row[order], a[order], z[order]
            # Running maximum of ends within a row, made global by an offset per row.
            far = int(z.max()) + 1
            top = np.maximum.accumulate(z + row * far)
            new = np.r_[True, a[1:] + row[1:] * far > top[:-1]]
            at = np.flatnonzero(new)
            ends = top[np.r_[at[1:], len(top)] - 1] - row[at] * far
            for r, s, e in zip(row[at].tolist(), a[at].tolist(), ends.tolist(), strict=True):
                spans.setdefault(r, []).append((s, e))
        bodies = docs.column(text).to_pylist()
        made = [finish(b.encode() if b else b"", spans.get(p, [])) for b, p in zip(bodies, place.tolist(), strict=True)]
        out = docs.select(kept)
        for i, (name, kind) in enumerate(finish.columns):
            out = out.append_column(name, pa.array([m[i] for m in made], kind))
        return out

    return run


def _kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(body[at:s])
        at = e
    return b"".join([*out, body[at:]])


class _Digest:
    columns = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __call__(self, body: bytes, spans: list) -> tuple:
        return len(body), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(body, spans)).hexdigest()


class _Cut:
    """The remaining text; bytes of a character that was cut in two go as well."""

    def __init__(self, name: str) -> None:
        self.columns = [(name, pa.string()), ("__removed", pa.int64())]
        self.ddl = f"`{name}` string, __removed long"

    def __call__(self, body: bytes, spans: list) -> tuple:
        return _kept(body, spans).decode("utf-8", "ignore"), sum(e - s for s, e in spans)


def suffix_dedup(docs: DataFrame, finish: Callable, kept: list[str], key: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``kept`` columns of every row and those that ``finish`` makes of its text and removed spans."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // BLOCK))
    mark = "__mark"
    rows = docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn(mark, F.xxhash64(text))
    # A block is chosen by key, text and place in the scan, so rows that are wholly alike, however many, spread.
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(key, mark, place), F.lit(buckets)).cast("int"))
    # One exchange, by block, for the three stages that read text.
    rows = rows.repartition(buckets, "__block")
    keys = (key, mark)
    by_block = rows.groupBy("__block")
    body = "bucket int, block int, body binary"
    hash_buckets = max(shuffle_partitions(spark), -(-total // HASHED))
    sent = by_block.applyInArrow(tidy(_hashes_of_block(keys, text, hash_buckets, length, gram)), body)
    # Dealt out by count, as the packed rows' sizes say little about the work in them.
    flags = sent.repartition(hash_buckets, "bucket").groupBy("bucket").applyInArrow(tidy(_shared), "block int, bucket int, body binary")
    segments = by_block.cogroup(flags.groupBy("block")).applyInArrow(tidy(_segments_of_block(keys, text, buckets, length, gram, hash_buckets)), body)
    found = segments.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy(_match(length)), "block int, body binary")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return by_block.cogroup(found.groupBy("block")).applyInArrow(tidy(_cut_block(keys, text, kept, finish)), f"{fields}, {finish.ddl}")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH) -> DataFrame:
    """The rows with the repeated passages cut from their text; a text that vanishes wholly goes with its row."""
    out = suffix_dedup(packed(docs, key, text), _Cut("text"), ["key", "rest"], "key", "text", length=length)
    return unpacked(out.where((F.length("text") > 0) | (F.col("__removed") == 0)), docs.columns, key, text)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, removed bytes and digest of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, _Digest(), ["doc_id"])
