"""Scalar functions as Column expressions.  Patterns carry (?U), as \\w, \\s and \\b must know Unicode."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..dims import CONTEXTS, CROSS, ENUMS, FALSE_WORDS, HOMOGLYPHS, TRACKING, TRUE_WORDS, UNITS

_ASCII = r"^[\x00-\x7F]*$"
# ---- fixed values ----
#: A number, with groups of three or a decimal part, not inside a word or another number; then a unit.
NUMBER = r"(?U)(?<![\w.,])([-+]?\d+(?:[ ,.\x{A0}]\d{3})*(?:[.,]\d+)?)(?!\d)\s*([A-Za-zА-Яа-яЁёіІїЇєЄ·⁻¹/\"″]{0,8})"
CODE = r"(?U)\b[A-Z]{1,6}[- ]?\d{1,5}[A-Z0-9\-/.]*\b"
# ---- end of fixed values ----


def constant(value: object, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), ddl)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts.to_pylist()], pa.string())


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nfkc(c: Column) -> Column:
    """Only texts beyond ASCII cross to Python; the others travel as nulls."""
    return F.when(c.rlike(_ASCII), c).otherwise(_nfkc(F.when(~c.rlike(_ASCII), c)))


def casefold(c: Column) -> Column:
    """Compatibility form, then case folding."""
    return F.when(c.rlike(_ASCII), F.lower(c)).otherwise(_folded(F.when(~c.rlike(_ASCII), c)))


def canonical_string(c: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(casefold(c), r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-_/]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"(?U)[^\w\s.]", ""), r"(?U)^\s+|\s+$", "")


def parse_number(token: Column) -> Column:
    """The last of two kinds of separator is the decimal one; one comma with three digits after it groups."""
    t = F.regexp_replace(F.trim(token), r"[ \x{A0}]", "")
    comma, dot = F.instr(t, ","), F.instr(t, ".")
    last_comma, last_dot = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    both = F.when(last_comma < last_dot, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    only = F.when(t.rlike(r"^[^,]{0,3},[^,]{3}$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when((comma > 0) & (dot > 0), both).when(comma > 0, only).otherwise(t).try_cast("double")


def quantities(text: Column) -> Column:
    """array of (n, u, c, f): numbers of a folded text, the unit spelled after each, its canonical one and factor."""
    table = constant({k: {"c": c, "f": f} for k, (c, f) in UNITS.items()}, "map<string,struct<c:string,f:double>>")
    numbers, units = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    spelled = F.zip_with(numbers, units, lambda n, u: F.struct(parse_number(n).alias("n"), F.rtrim(F.trim(u), F.lit(".")).alias("u")))
    known = F.filter(spelled, lambda x: x["n"].isNotNull())
    return F.transform(known, lambda x: F.struct(x["n"].alias("n"), x["u"].alias("u"), F.try_element_at(table, x["u"])["c"].alias("c"), F.try_element_at(table, x["u"])["f"].alias("f")))


def quantity_in(found: Column, unit: Column) -> Column:
    """struct(value, unit): of ``quantities``, the first whose unit converts to ``unit``, else the first bare one."""
    cross = constant({f"{a}>{b}": f for (a, b), f in CROSS.items()}, "map<string,double>")

    def convert(x: Column) -> Column:
        same = unit.isNull() | (x["c"] == unit)
        rate = F.when(same, F.lit(1.0)).otherwise(F.try_element_at(cross, F.concat(x["c"], F.lit(">"), unit)))
        converted = F.struct(F.round(x["n"] * x["f"] * rate, 4).alias("value"), F.when(same, x["c"]).otherwise(unit).alias("unit"), F.lit(0).alias("bare"))
        return F.when(x["c"].isNotNull(), converted).when(x["u"] == "", F.struct(x["n"].alias("value"), F.coalesce(unit, F.lit("")).alias("unit"), F.lit(1).alias("bare")))

    read = F.transform(found, convert)
    best = lambda bare: F.get(F.filter(read, lambda x: (x["bare"] == bare) & x["value"].isNotNull()), F.lit(0))
    return F.coalesce(best(0), best(1)).dropFields("bare")


def parse_quantity(raw: Column, unit: Column, normalized: bool = False) -> Column:
    """struct(value, unit) of a text.  ``normalized``: it needs no compatibility form (it is ASCII)."""
    return quantity_in(quantities(F.lower(raw if normalized else nfkc(raw))), unit)


def value_of(text: Column, canon: Column, found: Column, kind: Column, unit: Column, field: Column) -> Column:
    """struct(num, str, bool, list, unit) of a stripped text, its canonical form and its ``quantities``; null if it
    has no value."""
    quantity = quantity_in(found, unit)
    starts = lambda words: reduce(or_, [canon.startswith(w) for w in words])
    truth = F.when(starts(TRUE_WORDS), F.lit(True)).when(starts(FALSE_WORDS), F.lit(False))
    named = F.lit(None).cast("string")
    for key, values in ENUMS.items():
        pick = canon
        for name, spellings in reversed(values.items()):
            pick = F.when(reduce(or_, [canon.contains(x) for x in spellings]), F.lit(name)).otherwise(pick)
        named = F.when(field == key, pick).otherwise(named)
    items = F.filter(F.transform(F.split(text, r"[;,\n•]+"), stripped), lambda x: x != "")
    none = {"num": F.lit(None).cast("double"), "str": F.lit(None).cast("string"), "bool": F.lit(None).cast("boolean"), "list": F.lit(None).cast("array<string>"), "unit": F.lit(None).cast("string")}
    whole = lambda **own: F.struct(*[own.get(k, v).alias(k) for k, v in none.items()])
    number = whole(num=quantity["value"], unit=F.coalesce(F.nullif(quantity["unit"], F.lit("")), unit))
    said = F.coalesce(named, canon)
    return (
        F.when(text == "", None).when(kind == "number", F.when(quantity.isNotNull(), number)).when(kind == "bool", F.when(truth.isNotNull(), whole(bool=truth)))
        .when(kind == "enum", F.when(said.isNotNull(), whole(str=said))).when(kind == "list", F.when(F.size(items) > 0, whole(list=items))).otherwise(whole(str=F.regexp_replace(text, r"(?U)\s+", " ")))
    )


def equivalent(a: Column, b: Column, kind: Column, tolerance: Column) -> Column:
    """Of two value structs (num, str, bool, list); strings and lists must be canonical already."""
    near = F.abs(a["num"] - b["num"]) <= F.greatest(tolerance * F.greatest(F.abs(a["num"]), F.abs(b["num"])), F.lit(1e-9))
    shared = F.size(F.array_intersect(a["list"], b["list"])) / F.nullif(F.size(F.array_union(a["list"], b["list"])), F.lit(0))
    return F.coalesce(F.when(kind == "number", near).when(kind == "list", shared >= 0.8).when(kind == "bool", a["bool"] == b["bool"]).otherwise(a["str"] == b["str"]), F.lit(False))


def gtin_checksum_ok(code: Column) -> Column:
    """Weights 3 and 1 from the right of the body; lengths 8, 12, 13, 14."""
    body = F.reverse(F.left(code, F.length(code) - 1))
    digits = F.transform(F.split(body, ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda s, d: s + d)
    return F.coalesce(code.rlike(r"^(\d{8}|\d{12,14})$") & (F.pmod(F.lit(10) - total % 10, F.lit(10)) == F.right(code, F.lit(1)).try_cast("int")), F.lit(False))


def normalize_gtin(code: Column) -> Column:
    d = F.regexp_replace(code, r"\D", "")
    return F.when(gtin_checksum_ok(d), F.when(d.rlike(r"^0\d{13}$"), F.substring(d, 2, 13)).when(F.length(d) == 12, F.concat(F.lit("0"), d)).otherwise(d))


def find_gtins(text: Column) -> Column:
    """Of maximal runs of digits, in order, each once."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.length(x).isin(8, 12, 13, 14))
    return F.array_distinct(F.filter(F.transform(runs, normalize_gtin), lambda x: x.isNotNull()))


def flat(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"(?U)[\s\-_/.]", "")


def normalize_model(c: Column) -> Column:
    return F.when(F.length(c) > 0, flat(c))


def codes_in(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(F.upper(text), F.lit(CODE), F.lit(0)), lambda x: F.length(x) >= 4)
    return F.array_distinct(F.transform(found, flat))


def occurrences(text: Column, part: Column) -> Column:
    """Without overlap; an empty part does not occur."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def sibling_of(target: Column, code: Column) -> Column:
    short = target.startswith(code) & (F.length(target) - F.length(code) <= 3)
    long = code.startswith(target) & (F.length(code) - F.length(target) <= 3)
    differing = F.aggregate(F.zip_with(F.split(code, ""), F.split(target, ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    return (code != target) & (short | long | ((F.length(code) == F.length(target)) & (differing == 1)))


def _url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    t = F.trim(url)
    part = lambda i: F.regexp_extract(t, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    return part(1), part(2), part(3), part(4)


def normalize_url(url: Column) -> Column:
    scheme, authority, path, query = _url_parts(url)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.substring_index(kv, "=", 1).isin(TRACKING)), "&")
    start = F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when((authority != "") | (scheme != ""), F.lit("//")).otherwise(""), F.lower(authority))
    return F.concat(start, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(_url_parts(url)[1]), r"^www\.", "")


def key_norm(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(key), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def context_of(key: Column, raw: Column) -> Column:
    """The first of the contexts that key and value speak of."""
    blob = F.concat(key, F.lit(" "), raw)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CONTEXTS):
        out = F.when(blob.rlike("(?iU)" + pattern), F.lit(name)).otherwise(out)
    return out


def spaced(c: Column, normalized: bool = False) -> Column:
    """The compatibility form in lower case, each white space one blank."""
    return F.lower(F.trim(F.regexp_replace(c if normalized else nfkc(c), r"(?U)\s+", " ")))


def grounded_in(r: Column, s: Column) -> Column:
    """Of two ``spaced`` texts: the value stands in the span, or all its numbers (at least one) and units do."""
    numbers = F.regexp_extract_all(r, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    units = F.regexp_extract_all(r, F.lit(r"([a-zа-яіїє·⁻¹/]+)"), F.lit(1))
    # The span goes along in an array: a function inside an array cannot reach out to a Python one.
    inside = lambda own: F.forall(F.zip_with(own, F.array_repeat(s, F.size(own)), lambda x, t: t.contains(x)), lambda x: x)
    parts = (F.size(numbers) > 0) & inside(numbers) & inside(units)
    return (r != "") & (s.contains(r) | parts)


def grounded(raw: Column, span: Column, normalized: bool = False) -> Column:
    return grounded_in(spaced(raw, normalized), spaced(span, normalized))


def in_range(value: Column, kind: Column, lo: Column, hi: Column) -> Column:
    return F.when((kind != "number") | lo.isNull(), F.lit(True)).otherwise(F.coalesce(value.between(lo, hi), F.lit(False)))


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def shingles_of(words: Column, k: int = 4) -> Column:
    """Distinct runs of ``k`` words; none of fewer words.  The words are zipped with themselves, shifted."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    shifted = [F.slice(words, i + 1, n) for i in range(k)]
    joined = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), shifted)
    return F.coalesce(F.array_distinct(joined), F.array().cast("array<string>"))


def shingles(text: Column, k: int = 4) -> Column:
    return shingles_of(words_in(text), k)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def unmixed(token: Column) -> Column:
    """A token that mixes digits with Cyrillic letters, in the Latin ones that look alike."""
    return F.when(token.rlike("[А-Яа-я]") & token.rlike(r"\d"), F.translate(token, *HOMOGLYPHS)).otherwise(token)


def _indel(a: str, b: str) -> float:
    """Normalised similarity by insertions and deletions, 0 to 100."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_similarity(a: str, b: str) -> float:
    """Best similarity among the shared words and the shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    left, right = f"{shared} {only_x}".strip(), f"{shared} {only_y}".strip()
    options = [_indel(left, right)]
    if shared:
        options += [_indel(shared, left), _indel(shared, right)]
    return max(options)


@F.arrow_udf(DoubleType())
def token_set_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([token_set_similarity(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())
