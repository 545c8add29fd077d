"""Columns named like those that operators use inside pass through; hot keys meet their facts."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import common as C
from factloom.llm import quality as Q
from factloom.llm import secrets as S
from factloom.llm import simhash as H
from factloom.llm import suffix_dedup as D
from factloom.llm import toxicity as T

NAMES = {
    "redact": "__name __live __mark __owner __found __rid __spans rest owner name live value n".split(),
    "simhash": "__k __z __m __mark __fp __root __component __set node root cells first mark k z m rest".split(),
    "suffix": "__block __mark __removed block bucket body rest __none".split(),
    "rated": "__words __n __h __pairs __lines __g __s __p __t __k __key __row __text h b w x z".split(),
    "scored": "__p p row __k __y".split(),
}


def docs_with(spark, names):
    rows = [(i, f"word{i} " * 60 + "password = abcDEF123456xyz", "s", *[f"{n}{i}" for n in names]) for i in range(4)]
    rows += [(None, None, None, *[None] * len(names)), (9, "", "s", *["e"] * len(names)), (9, "", "s", *["e"] * len(names))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize("name", list(NAMES))
def test_columns_pass_through(spark, name):
    docs = docs_with(spark, NAMES[name])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    run = {
        "redact": S.redact, "simhash": H.deduplicate, "suffix": D.deduplicate, "rated": lambda d: Q.rated(d, labels),
        "scored": lambda d: T.scored(d, T.Chain(["a"], {}, [None], [set()])),
    }[name]
    out = run(docs)
    assert [c for c in docs.columns if c in out.columns] == docs.columns
    own = {r["doc_id"]: r for r in docs.collect()}
    got = out.collect()
    assert {r["doc_id"] for r in got} == ({0, 1, 2, 3, 9} if name == "simhash" else set(own))  # null and empty texts are one group
    for r in got:
        assert all(r[n] == own[r["doc_id"]][n] for n in NAMES[name])
    assert run(docs.limit(0)).count() == 0


def test_hot_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    out = C.hot_join(rows, facts, "k", "n", 5000)
    want = {(r["k"], r["v"], r["top"]) for r in rows.join(facts, "k").collect()}
    assert {(r["k"], r["v"], r["top"]) for r in out.collect()} == want and out.count() == 5000
