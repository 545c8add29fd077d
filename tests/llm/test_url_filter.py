"""The automaton against fnmatch-like regular expressions, and the rules against the SQL."""

import random
import re

import duckdb

from factloom.llm import url_filter as U


def slow(glob, url):
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        else:
            if c == "\\" and at + 1 < len(glob):
                at += 1
                c = glob[at]
            out += re.escape(c)
        at += 1
    return re.fullmatch(out.encode(), url, re.S) is not None


def test_automaton():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("ab*?\\c") for _ in range(n))
    globs = ["", "*", "?", "a*", "*a", "a\\*b", "**a**b", "x" * 100 + "*y", "*" + "z" * 70] + [make(rng.randint(0, 7)) for _ in range(60)]
    urls = ["", "a", "a*b", "x" * 100 + "qqy", "q" + "z" * 70, "é"] + ["".join(rng.choice("ab*?\\c") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    got = U.GlobAutomaton(globs).match([u.encode() for u in urls])
    for u, row in zip(urls, got):
        assert row.tolist() == [slow(g, u.encode()) for g in globs], u
    assert U.GlobAutomaton([]).match([b"a"]).shape == (1, 0) and U.GlobAutomaton(["a"]).match([]).shape == (0, 1)


def test_rules_against_sql(spark):
    urls = [None, "", "no scheme", "http://NET/x", "http://net", "https://a.example.net/en/x?q#f", "https://example.net/EN/x", "http://badexample.net/en/", "http://x.example.com/de/1?casino", "http://x.example.com/fr/casino", "HTTP://Spam-Farm.example.org/en/", "https://a.org/fr/", "https://a.org/fr", "http://h.com?x=/p", "http://h.com#a/b", "http://u@h.com:80/p.exe#x.exe", "a://b://c.net/", "http://h.com/a\nb.zip", "http://É.net/a"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(1, "", "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, extra string")
    got = sorted(tuple(r) for r in U.judge(df).select("page_id", "host", "path", "rule", "verdict").fillna("-").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(tuple("-" if x is None else x for x in r) for r in con.execute(U.ORACLE_SQL).fetchall())
    assert got == want
    by = {r[0]: r[3:] for r in got}
    assert by[0] == ("-", "allow") and by[3] == ("net/", "block") and by[4] == ("-", "allow") and by[5] == ("example.net/en/", "allow") and by[6] == ("net/", "block") and by[9] == ("-", "block") and by[10] == ("-", "block") and by[11] == ("org/fr/", "allow")
    assert U.judge(df.where("page_id > 99")).count() == 0
