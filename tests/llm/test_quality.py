"""Against a plain reading of the contract, and held-out labels."""

import random
import re
from collections import Counter
from math import log

import xxhash

from factloom.llm import quality as Q


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bins_of(words):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    pair = [xxhash.xxh64_intdigest(a.to_bytes(8, "little"), xxhash.xxh64_intdigest(b.to_bytes(8, "little"), 42)) for b, a in zip(h, h[1:])]
    return [signed(x) % Q.BUCKETS for x in h + pair]


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def rows_of():
    rng = random.Random(1)
    words = ["a", "b", "é€", "#x", "<b>", "&amp;", "the", "quick", "x" * 30]
    seps = [" ", "\n", "\t", "  ", "\r\n", "\v", "\f", " \n\n "]
    texts = ["".join(rng.choice(words[: rng.randint(2, 9)]) + rng.choice(seps) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["".join(rng.choice(words) + "%d" % rng.randint(0, 50) + " " for _ in range(90)) for _ in range(20)]
    texts += [None, "", " \n\t", "a b c a b c", "a a a a", "a b", "x y z " * 60, " line\nline\n line\n\x85\n\x85\n\xa0"]
    return [(i, t, "k") for i, t in enumerate(texts)] + [(5, texts[5], "again"), (None, texts[155], "n")]


def test_statistics_and_score(spark):
    rows = rows_of()
    labels = [(i, 1 if i % 3 else 0) for i in range(0, 160)] + [(None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score2 string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    raw, target = Counter(), Counter()
    good = {i for i, q in labels if q and i is not None}
    for i, t, _ in rows:
        own = bins_of([w for w in re.split(r"[\x20\x09-\x0D]", t or "") if w])
        raw.update(own)
        if i in good:
            target.update(own)
    r_all, t_all = sum(raw.values()), sum(target.values())
    prior = Q.PRIOR + Q.PRIOR_GRAMS / t_all
    weight = {b: log((target[b] * r_all / (n * t_all) + prior) / (1 + prior)) for b, n in raw.items()}
    got = Q.rated(df, lab, threshold=-0.05).collect()
    assert len(got) == len(rows)
    texts = {(i, x): t for i, t, x in rows}
    for r in got:
        t = texts[r["doc_id"], r["score2"]]
        want = plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, t
        own = bins_of([w for w in re.split(r"[\x20\x09-\x0D]", t or "") if w])
        score = sum(weight[b] for b in own) / len(own) if own else 0.0
        assert abs(score - r["score"]) < 1e-9 and r["kept"] == (not want[-1] and score >= -0.05)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(i, f"word{i} and more words stand here {i}") for i in range(60)] + [(61, " ".join(map(str, range(60))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["doc_id"] for r in Q.keep_good(df, none).collect()] == [61]
    assert Q.rated(df.where("doc_id > 99"), none).count() == 0
    clash = df.withColumns({"score": df["doc_id"] * 0 + 7, "kept": df["text"], "__words": df["text"]})
    got = Q.keep_good(clash, none).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(61, 7)] and got[0]["kept"] == got[0]["text"] and got[0]["__words"] == got[0]["text"]


def test_held_out_documents(spark, sf_dir):
    """Fitted on half of the labels, the rule keeps good documents of the other half and rejects bad ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = Q.rated(docs.select("doc_id", "text"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    by = {(r["quality"], r["kept"]): r["count"] for r in out.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) == 0 and by[0, False] >= 5
