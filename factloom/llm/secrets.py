"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in each whole text.  Base kinds (assign, access, hex) are always reported.  The
method weighs every candidate's value by who holds it: its hash is counted over distinct owners and over
distinct (owner, repository) pairs of the whole corpus.  A value that many own is a widely copied example; one
that few own, however often they repeat it, and that does not look like filler, looks live.  Further kinds (vendor, jwt, pem), too general to
report everywhere, are added as spans where their value looks live.

The counts are three nested aggregations, (value, owner, repository) -> (value, owner) -> (value), each
with partial sums before its exchange, so a value in a third of all texts costs one row per task and owner.

Defined results: a null text is empty; a null owner is one owner by itself; repeated rows of one repository
count once; texts without candidates return no spans; extra columns pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, hot_join, packed, table, unpacked

#: In the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "vendor", "jwt", "pem"]
BASE = KINDS[:3]
#: A value held by more owners is a widely copied example.  More repositories of so few owners do not make it one:
#: they are told beside the owners, and ``live`` does not depend on them.
MOST_OWNERS, MOST_REPOSITORIES = 3, 8
#: Fewer distinct characters are filler (xxxxxxxx, 00000000).
LEAST_CHARACTERS = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 or more among the longest runs
_VENDOR = re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----")
#: Text in lower case must hold one of these for the pattern to be worth a scan.
_ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")
_VENDOR_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk_live_", "AIza")


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in code points, in the order of the result."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    if any(h in text for h in _VENDOR_HINTS):
        out += [(m.start(), 3, m.end(), m[0]) for m in _VENDOR.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end(), m[0]) for m in _JWT.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [(m.start(), 5, m.end(), m[0]) for m in _PEM.finditer(text)]
    return sorted(out)


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, key: str, text: str, owner: str) -> DataFrame:
    """(key, __mark, __owner, n_*, base_sha256, __found) of every row; the text stays behind."""
    found = "array<struct<start:long,kind:int,end:long,value:long,filler:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64()), ("filler", pa.bool_())]))
        for batch in batches:
            n: list[list[int]] = [[], [], []]
            digests, rows = [], []
            for text in batch.column(3).to_pylist():
                own = candidates(text or "")
                base = [x for x in own if x[1] < len(BASE)]
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows.append([{"start": s, "kind": k, "end": e, "value": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "filler": len(set(v)) < LEAST_CHARACTERS} for s, k, e, v in own])
            cols = [batch.column(0), batch.column(1), batch.column(2), *[pa.array(x, pa.int64()) for x in n], pa.array(digests, pa.string()), pa.array(rows, kind)]
            yield pa.record_batch(cols, [key, "__mark", "__owner", "n_assign", "n_access", "n_hex", "base_sha256", "__found"])

    given = docs.select(key, F.xxhash64(text).alias("__mark"), F.col(owner).cast("string").alias("__owner"), text)
    ddl = docs.schema[key].dataType.simpleString()
    return given.mapInArrow(run, f"`{key}` {ddl}, __mark long, __owner string, n_assign long, n_access long, n_hex long, base_sha256 string, __found {found}")


def ownership(found: DataFrame, key: str) -> DataFrame:
    """(value, owners, repositories, n, live) over the corpus; n: the value's candidates."""
    each = found.select(F.col(key).alias("repository"), F.col("__owner").alias("owner"), F.explode("__found.value").alias("value"))
    pairs = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = pairs.groupBy("value", "owner").agg(F.count("*").alias("held"), F.sum("n").alias("n"))
    out = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("held").alias("repositories"), F.sum("n").alias("n"))
    return out.withColumn("live", F.col("owners") <= MOST_OWNERS)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """What ``scan`` gives, in the checkpoint folder, with ``__spans``: (start, kind, end, live) in order."""
    found = checkpoint(scan(docs, key, text, owner).withColumn("__rid", F.monotonically_increasing_id()))
    each = found.where(F.size("__found") > 0).select("__rid", F.explode("__found").alias("c")).select("__rid", "c.*")
    facts = checkpoint(ownership(found, key).select("value", "live", "n"))
    total = facts.agg(F.sum("n")).first()[0] or 0
    told = hot_join(each, facts, "value", "n", total)
    span = F.struct("start", "kind", "end", (F.col("live") & ~F.col("filler")).alias("live"))
    spans = told.groupBy("__rid").agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    return found.join(spans, "__rid", "left")


def _reported(spans: Column) -> Column:
    return F.filter(spans, lambda s: (s["kind"] < len(BASE)) | s["live"])


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Counts, digest of the base spans, all reported spans, and how many candidates look live or copied."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(_reported(F.col("__spans")), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    count = lambda live: F.coalesce(F.size(F.filter("__spans", lambda s: s["live"] == live)), F.lit(0)).cast("long")
    return judged(docs, key, text, owner).select(
        key, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join(said, ","), F.lit("")).alias("spans"),
        F.when(F.col("__spans").isNull(), 0).otherwise(count(True)).alias("n_live"), F.when(F.col("__spans").isNull(), 0).otherwise(count(False)).alias("n_copied"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", *, mask: str = "[secret]") -> DataFrame:
    """The rows with every live-looking span masked; widely copied examples and filler stay."""
    nil = F.lit("0").cast(docs.schema[key].dataType)
    rows = packed(docs.withColumn(text, F.col(text).cast("string")), key, text).withColumn("owner", F.col("rest")[owner].cast("string"))
    name = lambda mark: F.xxhash64(F.coalesce("key", nil), F.col("key").isNull(), mark)
    live = judged(rows, "key", "text", "owner").select(name(F.col("__mark")).alias("name"), F.filter("__spans", lambda s: s["live"]).alias("live"))
    live = live.where(F.size("live") > 0).groupBy("name").agg(F.first("live").alias("live"))

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            parts, at = [], 0
            for s in own or []:
                if s["end"] > at:
                    parts += [t[at : max(at, s["start"])], mask] if s["start"] >= at else []
                    at = s["end"]
            out.append("".join([*parts, t[at:]]) if own else t)
        return pa.array(out, pa.string())

    named = rows.withColumn("name", name(F.xxhash64("text"))).join(live, "name", "left")
    return unpacked(named.withColumn("text", masked(F.col("text"), F.col("live"))), docs.columns, key, text)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_spans(table(spark, sf_dir, "documents"))
