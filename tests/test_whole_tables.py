"""Queries that must cover whole tables, against brute force."""

import re
from decimal import ROUND_HALF_UP, Decimal

from factloom.dims import UNITS
from factloom.plans.registry import QUERIES
from factloom.sources import leads as L


def test_search_equals_the_nested_loop(spark):
    fold = lambda t: re.sub(r"[\s\-_/\"']", "", t).lower()
    queries = [("a", 1, "Bosch GSR 12V-35 drill"), ("a", 1, "Bosch GSR 12V-35 drill"), ("b", 2, "gsr12v35 gsr-12v-35"), ("c", 3, ""), ("d", 4, "other")]
    index = [(0, ["GSR 12V-35", "bosch"], None), (0, ["GSR 12V-35", "bosch"], None), (1, ["gsr", "GSR", "drill"], ["35"]), (2, None, ["bosch"]), (3, [], None), (4, ["--"], None), (5, ["none"], None)]
    q = spark.createDataFrame(queries, "product_id string, query_ord int, text string")
    ddl = "lead_ord int, match_any array<string>, require_all array<string>, url string, title string, snippet string, tier string"
    i = spark.createDataFrame([(*x, f"u{x[0]}", None, None, "A") for x in index], ddl)
    want = sorted((p, n) for p, _, t in queries for n, some, every in index if (not some or any(fold(x) in fold(t) for x in some)) and all(fold(x) in fold(t) for x in every or []))
    assert sorted((r["product_id"], r["lead_ord"]) for r in L.fixture_search(q, i).collect()) == want


def test_every_part_in_every_unit(spark, sf_dir):
    units = {s: (c, f) for s, (c, f) in UNITS.items() if s.isascii() and s.isalpha()}
    parts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").collect()}
    half_up = lambda x: float(Decimal(x).quantize(Decimal("0.0001"), ROUND_HALF_UP))  # as in unit_convert's SQL
    got = {(r["p_partkey"], r["spelling"]): (r["canon"], r["value"]) for r in QUERIES["unit_convert"](spark, sf_dir).collect()}
    assert got == {(p, s): (c, half_up(n * f)) for p, n in parts.items() for s, (c, f) in units.items()}


def test_whole_texts_are_compared(spark, tmp_path):
    same = "one two three four five six seven eight nine ten " * 6
    texts = [same + "alpha beta gamma delta epsilon", same + "other words stand at the end here", "Ünï a_b 3 x y " + same, "short text", None, "", "a b c d", "A, b; c d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {" ".join(w[i : i + 4]) for i in range(max(0, len(w) - 3))}

    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: (r["shingles"], r["jaccard"]) for r in QUERIES["shingle_jaccard"](spark, str(tmp_path)).collect()}
    for i, (a, b) in enumerate(zip(sets, sets[1:])):
        if texts[i] is not None:
            assert got[i] == (len(a), round(1e6 * len(a & b) / len(a | b)) if a and b else 0), i
    assert got[0][1] < 1_000_000
