"""Copy chains, voting and statuses: the worked example's figures, and each rule alone."""

import pytest
from pyspark.sql import functions as F

from factloom.dims import attribute_specs
from factloom.operators import copychain, guard, vote
from factloom.plans.registry import line_claims

DEFAULTS = {"extractor": "kv", "extractor_confidence": 0.85, "entity_match": 0.9, "page_specificity": 1.0, "snapshot": "sha256:0", "fetched_at": "2026-09-04T00:00:00Z", "category": "tools/power_tools", "product_id": "p"}


def frame(spark, rows):
    """rows: (field, value, raw, url, domain, tier, overrides)."""
    names = [f.split()[0] for f in vote.CLAIMS.split(", ")]
    out = []
    for i, (field, value, raw, url, domain, tier, more) in enumerate(rows):
        r = dict(DEFAULTS, ord=i, field=field, raw=raw, span=f"{field}: {raw}", url=url, domain=domain, tier=tier, **more)
        r["bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "list" if isinstance(value, list) else "num"] = value if isinstance(value, (bool, str, list)) else float(value)
        out.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(out, vote.CLAIMS)


def told(spark, df, **kw):
    return {r["field"]: r for r in vote.truth_discovery(df, attribute_specs(spark), **kw).collect()}


def demo(forum=True):
    """The worked example: a maker's page and datasheet, a catalogue, three copying shops and a forum."""
    rows = []

    def page(url, domain, tier, em, sp, conf, facts, cluster):
        for field, value, raw, *context in facts:
            rows.append((field, value, raw, url, domain, tier, {"entity_match": em, "page_specificity": sp, "extractor_confidence": 0.95 if context[:1] == ["jsonld"] else conf, "context": "net_without_battery" if context[:1] == ["net"] else None, "cluster": cluster}))

    page("https://m/p", "bosch-professional.example", "A", 1.0, 1.0, 0.85, [("weight_g", 590, "0.59 kg", "jsonld"), ("voltage_v", 12, "12 V"), ("max_torque_hard_nm", 35, "35 Nm"), ("max_torque_soft_nm", 20, "20 Nm"), ("no_load_speed_rpm", 1750, "1,750 rpm"), ("chuck_type", "FlexiClick", "FlexiClick"), ("weight_g", 590, "0.59 kg", "net"), ("motor_type", "brushless", "Brushless")], "c4")
    page("https://i/p", "icecat.example", "B", 0.9, 0.6, 0.85, [("weight_g", 590, "590 g"), ("voltage_v", 12, "12 V"), ("max_torque_hard_nm", 35, "35 Nm"), ("no_load_speed_rpm", 1750, "1750 rpm"), ("motor_type", "brushless", "brushless")], "c2")
    for s in "abc":
        page(f"https://shop-{s}/p", f"shop-{s}.example", "C", 0.6, 1.0, 0.85, [("voltage_v", 12, "12 V"), ("max_torque_hard_nm", 30, "30 Nm"), ("weight_g", 800, "0.8 kg"), ("warranty_months", 24, "24 months"), ("color", "Blue", "Blue"), ("no_load_speed_rpm", 1750, "1750 rpm")], "c3")
    page("https://m/pdf", "bosch-professional.example", "A", 0.9, 1.0, 0.9, [("voltage_v", 12, "12 V"), ("max_torque_hard_nm", 35, "35 Nm"), ("max_torque_soft_nm", 20, "20 Nm"), ("no_load_speed_rpm", 1750, "1,750 rpm"), ("chuck_capacity_mm", "1 - 10 mm", "1 - 10 mm"), ("weight_g", 590, "0.59 kg", "net"), ("motor_type", "brushless", "Brushless (EC)")], "c5")
    if forum:
        page("https://f/t", "forum.example", "D", 0.9, 0.6, 0.85, [("warranty_months", 36, "3 years")], None)
    return rows


def test_worked_example(spark):
    got = told(spark, frame(spark, demo()))
    want = {
        "weight_g": ("verified", 0.933, "590", 3), "max_torque_hard_nm": ("verified", 0.927, "35", 3), "max_torque_soft_nm": ("verified", 0.99, "20", 2), "voltage_v": ("verified", 0.99, "12", 4),
        "no_load_speed_rpm": ("verified", 0.99, "1750", 4), "motor_type": ("verified", 0.99, "brushless", 3), "chuck_type": ("verified", 0.99, "FlexiClick", 1), "chuck_capacity_mm": ("verified", 0.99, "1 - 10 mm", 1),
        "color": ("single_source", 0.792, "Blue", 1), "warranty_months": ("conflict", 0.344, None, 1),
    }
    for field, (status, confidence, value, votes) in want.items():
        r = got[field]
        assert (r["status"], r["value"], r["independent_votes"]) == (status, value, votes), field
        assert r["confidence"] == pytest.approx(confidence, abs=1e-3), field
    assert got["weight_g"]["margin"] == pytest.approx(0.865, abs=1e-3) and got["warranty_months"]["margin"] == pytest.approx(0.435, abs=1e-3)
    c = {x["value"]: x for x in got["warranty_months"]["candidates"]}
    assert c["24"]["score"] == pytest.approx(0.717, abs=1e-3) and c["36"]["score"] == pytest.approx(0.283, abs=1e-3)
    assert got["max_torque_hard_nm"]["candidates"][0]["value"] == "30" and "copy-chain" in got["max_torque_hard_nm"]["candidates"][0]["rejected_reason"]
    weights = {r["domain"]: r["weight"] for r in vote.source_weights(frame(spark, demo()), attribute_specs(spark)).collect()}
    assert weights["bosch-professional.example"] == pytest.approx(1.88, abs=0.01) and weights["icecat.example"] == pytest.approx(1.71, abs=0.01) and weights["shop-a.example"] == pytest.approx(1.14, abs=0.01)


def test_gain_of_the_second_round(spark):
    before = vote.truth_discovery(frame(spark, demo(False)), attribute_specs(spark))
    first = {r["field"]: r for r in before.collect()}
    assert first["weight_g"]["confidence"] == pytest.approx(0.927, abs=1e-3) and first["warranty_months"]["status"] == "single_source"
    after = vote.truth_discovery(frame(spark, demo()), attribute_specs(spark))
    assert vote.gain(before, after).first()["gain"] == pytest.approx(0.46, abs=5e-3)


def test_copy_chain(spark):
    facts = [("max_torque_hard_nm", 30, "30 Nm"), ("voltage_v", 12, "12 V"), ("weight_g", 800, "0.8 kg"), ("warranty_months", 24, "24 months")]
    rows = [(f, v, r, f"https://{s}/1", f"{s}.example", "C", {}) for s in "xyz" for f, v, r in facts]
    rows += [("max_torque_hard_nm", 35, "35 Nm", "https://m/1", "m.example", "A", {"entity_match": 1.0}), ("max_torque_hard_nm", 35, "35 Nm", "https://i/1", "i.example", "B", {})]
    df = copychain.with_clusters(frame(spark, rows))
    by = {r["url"]: r["cluster"] for r in df.select("url", "cluster").distinct().collect()}
    assert len({by[f"https://{s}/1"] for s in "xyz"}) == 1 and len(set(by.values())) == 3
    r = told(spark, df.select(*[f.split()[0] for f in vote.CLAIMS.split(", ")]))["max_torque_hard_nm"]
    assert (r["status"], r["value"], r["independent_votes"]) == ("verified", "35", 2) and r["candidates"][0]["value"] == "30" and "copy-chain" in r["candidates"][0]["rejected_reason"]


def test_similar_blocks_and_owners(spark):
    base = [(f"f{i}", f"some long value number {i}") for i in range(30)]
    pages = {"a": base, "b": base[:29] + [("f29", "another value now")], "c": [(f"g{i}", f"other text {i}") for i in range(12)], "d": base[:2]}
    rows = [(f, v, v, f"https://{u}/", f"{u}.example", "C", {}) for u, own in pages.items() for f, v in own]
    rows += [("f1", "x y", "x y", "https://o1/", "shop-a.example", "C", {}), ("f1", "z", "z", "https://o2/", "shop-c.example", "C", {})]
    by = {r["url"][8:-1]: r["cluster"] for r in copychain.copy_clusters(frame(spark, rows)).collect()}
    assert by["a"] == by["b"] == "c1" and by["o1"] == by["o2"] and len({by["a"], by["c"], by["d"], by["o1"]}) == 4


def test_statuses(spark):
    one = lambda *rows: told(spark, frame(spark, list(rows)))
    shop, forum = ("warranty_months", 24, "24 months", "https://s/", "s.example", "C", {}), ("warranty_months", 36, "36 months", "https://f/", "f.example", "D", {})
    r = one(shop, forum)["warranty_months"]
    assert r["status"] == "conflict" and r["value"] is None and len(r["candidates"]) == 2 and r["sources"] == []
    maker = ("voltage_v", 12, "12 V", "https://m/", "m.example", "A", {"entity_match": 1.0})
    assert one(maker)["voltage_v"]["status"] == "verified" and one(maker)["voltage_v"]["method"] == "tier_a_override"
    against = [("voltage_v", 18, "18 V", f"https://{d}/", f"{d}.example", t, {}) for d, t in (("i", "B"), ("s", "C"))]
    assert one(maker, *against)["voltage_v"]["status"] == "conflict"
    ledger = spark.createDataFrame([("s.example", "tools/power_tools", "warranty_months", 9.0, 1.0)], "domain string, category string, field string, alpha double, beta double")
    a, b = told(spark, frame(spark, [shop, forum])), told(spark, frame(spark, [shop, forum]), ledger=ledger)
    assert b["warranty_months"]["margin"] > a["warranty_months"]["margin"]


def test_tolerance_and_lists(spark):
    rows = [("weight_g", v, str(v), f"https://{i}/", f"d{i}", "C", {}) for i, v in enumerate([590, 600, 610, 800])]
    rows += [("in_the_box", v, ", ".join(v), f"https://l{i}/", f"l{i}", "C", {}) for i, v in enumerate([["Tool", "Case"], ["case", "tool"], ["Tool", "Charger"]])]
    g = vote.group_claims(frame(spark, rows), attribute_specs(spark))
    sizes = sorted(r["count"] for r in g.where("field = 'weight_g'").groupBy("name").count().collect())
    assert sizes == [1, 1, 2]  # 590 leads 600; 610 is beyond 3 % of 590
    assert sorted(r["count"] for r in g.where("field = 'in_the_box'").groupBy("name").count().collect()) == [1, 2]


def test_order_of_rows_does_not_matter(spark):
    df = frame(spark, demo())
    key = lambda d: sorted((r["field"], r["status"], r["confidence"], r["value"] or "") for r in d.collect())
    assert key(vote.truth_discovery(df.orderBy(F.rand(1)).repartition(7), attribute_specs(spark))) == key(vote.truth_discovery(df, attribute_specs(spark)))


def test_guards(spark):
    rows = [("max_torque_hard_nm", 20, "20 Nm", "https://m/", "m.example", "A", {"entity_match": 1.0}), ("max_torque_soft_nm", 35, "35 Nm", "https://m/", "m.example", "A", {"entity_match": 1.0})]
    out = guard.cross_field(vote.truth_discovery(frame(spark, rows), attribute_specs(spark))).collect()
    assert all(r["status"] == "conflict" and r["value"] is None and r["confidence"] == 0.4 and r["warning"] for r in out)
    products = spark.createDataFrame([("p", "tools/power_tools")], "product_id string, category string")
    good = guard.with_unknown(vote.truth_discovery(frame(spark, demo()), attribute_specs(spark)), products, attribute_specs(spark))
    assert good.count() == 17 and guard.violations(good).count() == 0
    assert {r["field"] for r in guard.unresolved(good).collect()} >= {"core.length_mm", "core.warranty_months"}


def test_ledger_counts(spark):
    df = frame(spark, demo())
    seen = {(r["domain"], r["field"]): (r["agree"], r["disagree"]) for r in vote.agreement(df, vote.truth_discovery(df, attribute_specs(spark)), attribute_specs(spark)).collect()}
    assert seen["shop-a.example", "weight_g"] == (0, 1) and seen["bosch-professional.example", "weight_g"] == (3, 0) and ("forum.example", "warranty_months") not in seen


def test_empty(spark):
    assert vote.truth_discovery(line_claims(spark, "/root/testdata/sf0.001").limit(0), attribute_specs(spark)).count() == 0
