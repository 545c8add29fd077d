"""URL filters: allow and block rules by host and path, then globs run as one bit-parallel automaton.

The automaton packs all globs into words of 64 bits, one bit for each state, Shift-And with a self-loop
wherever a ``*`` stands, and reads all URLs of a batch one byte at a time.  Globs match the whole canonical
URL; ``*`` is any run of bytes, ``?`` one byte, a backslash makes the next character plain.

Canonical: the scheme in lower case, the host in lower case (A-Z), path and query as they are, no fragment.

Defined results: a null URL, or one without ``://``, has an empty host, path and canonical form, fits no rule
and only globs that match nothing at all; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, start of the path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: URLs that these match are blocked where no rule fits.
GLOBS = ["*://spam-*", "*://*.spam-*", "*casino*", "*/wp-login*", "*sessionid=*", "*.exe", "*.zip", "*://*/*/*/*/*/*/*/*"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class GlobAutomaton:
    """Which of the globs match a URL, for many URLs at a time."""

    def __init__(self, globs: list[str]) -> None:
        tokens, loops, finals = [], [], []  # one entry per state: its byte (None: any; "start"), looping, ...
        for glob in globs:
            tokens.append("start")
            loops.append(False)
            body, at = glob.encode(), 0
            while at < len(body):
                c = body[at : at + 1]
                if c == b"*":
                    loops[-1] = True
                elif c == b"?":
                    tokens.append(None)
                    loops.append(False)
                else:
                    at += c == b"\\" and at + 1 < len(body)
                    tokens.append(body[at])
                    loops.append(False)
                at += 1
            finals.append(len(tokens) - 1)
        n = max(1, -(-len(tokens) // 64))
        self.enter = np.zeros((256, n), np.uint64)  # states that a byte may enter from the one before
        self.loop, self.start = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i, (token, loop) in enumerate(zip(tokens, loops, strict=True)):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if loop:
                self.loop[word] |= bit
            if token == "start":
                self.start[word] |= bit
            elif token is None:
                self.enter[:, word] |= bit
            else:
                self.enter[token, word] |= bit
        self.final_word = np.array([f // 64 for f in finals], np.int64)
        self.final_bit = np.array([1 << (f % 64) for f in finals], np.uint64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row of truth values for each URL."""
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.repeat(self.start[None, :], len(urls), 0)
        data = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        first = (np.cumsum(size) - size)[order]
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        for at, n in enumerate(live.tolist()):  # the n longest still have a byte here
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.enter[data[first[:n] + at]]) | (now & self.loop)
        out = np.empty((len(urls), len(self.final_bit)), bool)
        out[order] = state[:, self.final_word] & self.final_bit != 0
        return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), path_of(url), query)).otherwise("")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, globs: list[str] | None = None) -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, or null), glob (the first that matches, or
    null) and verdict, which take the place of columns of these names."""
    rules, globs = RULES if rules is None else rules, GLOBS if globs is None else globs
    host, path = F.col("host"), F.col("path")
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)

    @F.arrow_udf("string")
    def first_glob(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = GlobAutomaton(globs)
        names = np.array([*globs, None], object)
        for batch in urls:
            out: list[np.ndarray] = []
            for at in range(0, len(batch), 4096):
                hit = automaton.match([u.encode() for u in batch.slice(at, 4096).to_pylist()])
                out.append(names[np.where(hit.any(1), hit.argmax(1), len(globs))])
            yield pa.array(np.concatenate(out) if out else [], pa.string())

    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "glob": first_glob(canonical(F.col(url)))})
    return out.withColumns({"rule": rule, "verdict": F.coalesce(said, F.when(F.col("glob").isNotNull(), "block").otherwise("allow"))})


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _like(glob: str) -> str:
    return glob.replace("%", r"\%").replace("_", r"\_").replace("*", "%")


ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), whole AS (
  SELECT *, CASE WHEN contains(u, '://') THEN translate(regexp_extract(u, '(?s)^(.*?)://', 1), '{_UPPER}', '{_LOWER}') || '://' || host || path
         || regexp_extract(u, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) ELSE '' END AS c,
         CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS said
  FROM parts
)
SELECT page_id, host, path, split_part(said, ' ', 2) AS rule,
       CASE WHEN said IS NOT NULL THEN split_part(said, ' ', 1)
            WHEN {" OR ".join(f"c LIKE '{_like(g)}' ESCAPE '{chr(92)}'" for g in GLOBS)} THEN 'block' ELSE 'allow' END AS verdict
FROM whole
"""
