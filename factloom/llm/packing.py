"""Best-fit packing of token pieces into sequences, reduced first by Martello and Toth's dominance.

The instance is the histogram of piece lengths, which has at most ``capacity`` entries at any input size.
On it, ``plan`` fixes sets that dominate every alternative and packs the rest by best fit, decreasing; both
work on whole classes of equal lengths, so the plan is a bounded table of (pattern, copies).  The pieces then
take their places by their rank among the pieces of their length.  Ranks come from counts per (length, hash
bucket) and a window inside each, with as many buckets as a length's pieces ask for, so one that a third of all pieces
share is spread.  Full pieces are sequences by themselves.

Tokens: a text's ids are those of its chunks between ASCII white space, because the tokenizer's normaliser,
splitter and special tokens never reach over it; and a chunk's are those of the splitter's pieces.  Each worker
keeps the ids of the chunks and pieces it has met, up to a bound, and encodes the rest in batches, many as one text.

Defined results: a null text is empty and still has its end token; a null key is a key like others; repeated
rows are packed separately, ties in rank go by key, piece and checksum; an empty table gives no sequences; other
columns play no part.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, constant, release, table

CAPACITY = 4096
END = 1
#: Bytes of chunks, their ids and what Python adds to each (``ENTRY``) that a worker keeps; it forgets all beyond that.
CACHED_BYTES, ENTRY = 96 << 20, 200
#: The same where packing runs by itself, so that no later step needs the memory of its idle workers, and a worker keeps
#: all for its next task.
CACHED_ALONE = 224 << 20
#: Bytes of text encoded at once.
SLICE = 4 << 20
#: Chunks that the tokenizer gets as one text, and chunks whose ids are gathered at once.
TOGETHER, GATHERED = 2000, 1 << 17
#: Pieces of one length that are ranked in one window, about.
RANKED = 100_000

#: Stands for the end of a chunk among ids; the ids of a blank and of an empty text.
GAP = 0xFFFFFFFF
NOTHING = {b" ": array("I", [GAP]).tobytes(), b"": b""}

assert sys.byteorder == "little" and array("I").itemsize == 4

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    #: The splitter's pieces, for ASCII text in lower case, and the blanks between chunks.
    PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]| |[^a-z0-9 ]+")
    #: A chunk that is one token.
    MARK = b"~"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = dict(NOTHING)
        self.held = 0
        (self.mark,) = self.tokenizer.encode(self.MARK.decode(), add_special_tokens=False).ids
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ending[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def of(path: str) -> ChunkEncoder:
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(path)
        return _encoders[path]

    def _ids(self, some: list[bytes], pieces: bool) -> list[bytes]:
        """Ids of each chunk: encoded as one text, as a call costs more than a chunk.  Each of the splitter's pieces has
        one token that ends it, its last; behind other chunks stands ``MARK``."""
        whole = b" ".join(some) if pieces else (b" " + self.MARK + b" ").join([*some, b""])
        ids = np.array(self.tokenizer.encode_batch_fast([whole.decode()], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ending[ids] if pieces else ids == self.mark)
        if len(last) != len(some):  # a chunk has the mark's id itself
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)]
        body, ends = ids.tobytes(), (4 * last + 4).tolist()
        drop = 0 if pieces else 4
        return [body[a : z - drop] for a, z in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, fresh: list[bytes], pieces: bool) -> None:
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            self._keep(some, self._ids(some, pieces))

    def _keep(self, some: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(some, ids, strict=True))
        self.held += sum(map(len, some)) + sum(map(len, ids)) + ENTRY * len(some)

    def _of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of these chunks, all different."""
        known = self.known
        found = list(map(known.get, chunks))
        fresh = [c for c, x in zip(chunks, found, strict=True) if x is None]
        plain = [c for c in fresh if c.isascii() and b"<|" not in c]
        # One list of the pieces and the gaps between chunks: a list for each chunk would keep the garbage collector busy.
        for at in range(0, len(plain), 5 * TOGETHER):
            some = plain[at : at + 5 * TOGETHER]
            pieces = self.PIECES.findall(b" ".join([*some, b""]))
            self._learn([p for p in set(pieces) if p not in known], True)
            ids = np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4")
            ends = np.flatnonzero(ids == GAP) * 4
            body = ids.tobytes()
            own = [body[a:z] for a, z in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]
            several = [c not in known for c in some]
            self._keep(list(compress(some, several)), list(compress(own, several)))
        self._learn([c for c in fresh if c not in known], False)
        return [known[c] if x is None else x for c, x in zip(chunks, found, strict=True)]

    def encode(self, texts: pa.Array, cached: int = CACHED_BYTES) -> list[bytes]:
        """Each text's ids; Arrow cuts the texts and finds the different chunks, which alone cross to Python."""
        if self.held > cached:
            self.known, self.held = dict(NOTHING), 0
        # The normaliser makes A-Z small and drops white space anyway; so it may be done first.
        own = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = own.flatten().dictionary_encode()
        # Joined and split again, as Arrow is slow to make many Python objects; no chunk holds a blank.
        different = words.dictionary.cast(pa.binary())
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(different)], different), b" ").to_pylist()[0]
        found = self._of_chunks(line.split(b" ") if len(different) else [])
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        word = words.indices.to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(size[word])]
        out = np.empty(ends[-1], "<u4")
        for at in range(0, len(word), GATHERED):
            part = word[at : at + GATHERED]
            upto = ends[at : at + len(part) + 1]
            out[upto[0] : upto[-1]] = ids[np.repeat(first[part] - upto[:-1], size[part]) + np.arange(upto[0], upto[-1])]
        places = ends[np.r_[0, np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))]].tolist()
        return [out[a:z].tobytes() for a, z in zip(places, places[1:])]


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of ``most`` bytes, or one text more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = min(len(texts), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield at, texts.slice(at, upto - at)
        at = upto


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, cached: int = CACHED_BYTES) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document's ids and its end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encoder, last = ChunkEncoder.of(str(path)), np.array([end], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for at, texts in _slices(batch.column(1), SLICE):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, body in enumerate(encoder.encode(texts, cached)):
                    body += last
                    for n, a in enumerate(range(0, len(body), step)):
                        part = body[a : a + step]
                        rows.append(at + row)
                        piece.append(n)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4"))
                cols = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(cols, names)
        if cached <= CACHED_BYTES:
            # Other steps go on in this worker: it keeps neither tokenizer nor ids beyond the task.
            del encoder
            _encoders.pop(str(path), None)
            release()

    kind = docs.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, ddl)


def _reduce(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fixes sets that dominate all others with their largest piece; lowers ``count``."""
    fixed: list[tuple[dict[int, int], int]] = []

    def take(parts: dict[int, int], copies: int) -> None:
        for n, k in parts.items():
            count[n] -= k * copies
        fixed.append((parts, copies))

    changed = True
    while changed:
        changed = False
        for big in np.flatnonzero(count)[::-1].tolist():
            while count[big]:
                rest = count.copy()
                rest[big] -= 1
                lengths = np.flatnonzero(rest[: capacity - big + 1])
                if not len(lengths):  # nothing fits beside it
                    take({big: 1}, int(count[big]))
                    changed = True
                    continue
                mate = int(lengths[-1])
                copies = int(count[big] // 2 if mate == big else min(count[big], count[mate]))
                parts = {big: 2} if mate == big else {big: 1, mate: 1}
                room = capacity - big
                # The largest fitting piece fills the room, or is worth any other set that fits.
                small = np.repeat(lengths[:3], np.minimum(rest[lengths[:3]], 3))[:3]
                one = len(small) < 2 or small[0] + small[1] > room
                two = len(small) < 3 or small.sum() > room
                if mate < room and not one and two:
                    below = np.zeros(room + 1, np.int64)  # largest length there is, at most so long
                    below[lengths] = lengths
                    below = np.maximum.accumulate(below)
                    other = below[room - lengths]
                    alone = (other == lengths) & (rest[lengths] < 2)
                    other[alone] = below[lengths[alone] - 1]
                    two = (np.where(other > 0, lengths + other, 0)).max() <= mate
                if mate == room or one or two and mate < room and not one and copies:
                    take(parts, copies)
                    changed = True
                else:
                    break
    return fixed


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, decreasing, on classes of equal bins."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    done: list[tuple[dict[int, int], int]] = []

    def put(parts: dict[int, int], copies: int, room: int) -> None:
        if not copies:
            return
        if room == 0:
            done.append((parts, copies))
            return
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((parts, copies))

    for n in np.flatnonzero(count)[::-1].tolist():
        left = int(count[n])
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                parts, copies = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, parts, copies = capacity, {}, -(-left // (capacity // n))
            # Bins of this class are the fullest that hold it, and stay so until full: fill them up.
            each = room // n
            full = min(copies, left // each)
            put(parts | {n: each}, full, room - each * n)
            left -= full * each
            if full < copies:
                if left:
                    put(parts | {n: left}, 1, room - left * n)
                    full += 1
                    left = 0
                if parts:
                    put(parts, copies - full, room)
    return done + [x for own in bins.values() for x in own]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: pieces} and how many sequences have each; ``count[n]`` pieces have the length n."""
    count = count.copy()
    return _reduce(count, capacity) + _best_fit(count, capacity)


def _slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, first offset), by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for parts, copies in patterns:
        offset = 0
        for n in sorted(parts, reverse=True):
            k = parts[n]
            rows.append((n, ranks.get(n, 0), k, sequence, offset))
            ranks[n] = ranks.get(n, 0) + k * copies
            offset += n * k
        sequence += copies
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, key: str = "doc_id", *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) and the sequence_id and offset of each."""
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    count = np.zeros(capacity + 1, np.int64)
    for n, k in sizes.items():
        count[n] = k
    # A full piece is a sequence by itself and needs no rank: its number is below 0.
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    count[capacity] = 0
    slots = _slots(plan(count, capacity))

    parts = constant((count // RANKED + 1).tolist(), "array<int>")
    dealt = pieces.where(F.col("length") < capacity).withColumn("__bucket", F.pmod(F.xxhash64(key, "piece"), F.get(parts, F.col("length").cast("int"))).cast("int"))
    # The number of cells is at most that of lengths and one for each RANKED pieces.
    cells = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "__bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__base"))
    order = Window.partitionBy("length", "__bucket").orderBy(key, "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(order)).join(base, ["length", "__bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("__base") + F.col("__rank") - 1).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = int(slots[:, 1].max()) + 1 if len(slots) else 1
        names = slots[:, 0].astype(object) * wide + slots[:, 1] if wide > 1 << 48 else slots[:, 0] * wide + slots[:, 1]
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            first = np.searchsorted(slots[:, 0], n)  # of its length; then the last whose rank is not above
            top = np.searchsorted(names, n * wide + np.minimum(rank, wide - 1), side="right") - 1
            s = slots[np.maximum(top, first)]
            at = rank - s[:, 1]
            sequence, offset = s[:, 3] + at // s[:, 2], s[:, 4] + at % s[:, 2] * n
            kept = batch.drop_columns(["__rank"])
            yield pa.record_batch([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").unionByName(full)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, parts), parts being (key, start, length, offset)."""
    packed = pack(checkpoint(token_pieces(docs, key, text, tokenizer=tokenizer, capacity=capacity, end=end, with_ids=True)), key, capacity=capacity)
    own = F.sort_array(F.collect_list(F.struct("offset", "length", "start", F.col(key).alias("key"), "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("parts"))


def packed_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, cached: int = CACHED_BYTES) -> DataFrame:
    """Every piece with its place, without its ids."""
    return pack(checkpoint(token_pieces(docs, key, text, tokenizer=tokenizer, cached=cached)), key)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"), cached=CACHED_ALONE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
