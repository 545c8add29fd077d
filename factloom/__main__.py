"""``python -m factloom "<product name>"``: one product from an index, recorded files or the web, as JSON and a summary."""

from __future__ import annotations

import argparse
import json
import os
import sys
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from .dims import BUDGETS
from .plans import cut
from .plans.resolve import resolve
from .sources import leads as L

#: Live connectors that need no key, and those that do with the variable that holds it.
FREE, KEYED = ["duckduckgo", "wikidata"], {"brave": "BRAVE_API_KEY", "serper": "SERPER_API_KEY"}
INDEX = "lead_ord int, url string, file string, tier string, title string, snippet string, match_any array<string>, require_all array<string>, ids array<string>"


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("name")
    p.add_argument("--mode", default="standard", choices=list(BUDGETS))
    p.add_argument("--offline", action="store_true", help="index and cache only")
    p.add_argument("--fixtures", help="an index.json, its files beside it")
    p.add_argument("--cache", help="folder of the page cache")
    p.add_argument("--tier-a", nargs="*", default=[], help="domains of manufacturers")
    p.add_argument("--tier-b", nargs="*", default=[])
    p.add_argument("--category")
    p.add_argument("--seconds", type=float, help="no round begins after so many")
    p.add_argument("--json", help="file for the document")
    p.add_argument("--trace", action="store_true")
    return p.parse_args(argv)


def host(url: str) -> str:
    return urlsplit(url).netloc.lower().removeprefix("www.")


def summary(d: dict) -> str:
    """The document as a short report."""
    i = d["identity"]
    out = [f"identity: {i['canonical_name']} [{i['status']} {i['confidence']:.2f}] mpn={i['mpn']['value']} gtins={i['gtins']['value']}"]
    for section in ("core", "attributes"):
        for k, f in d[section].items():
            value = f"{f['value']}{' ' + f['unit'] if f.get('unit') and f['value'] is not None else ''}"
            src = f" <- {len(f['sources'])} src, {f['resolution']['independent_votes']} indep" if f["sources"] else ""
            rest = f" | candidates: {[(c['value'], c['score']) for c in f['candidates']]}" if f["candidates"] else ""
            out.append(f"  {section}.{k:24s} {f['status']:14s} {f['confidence']:.2f}  {value}{src}{rest}")
    out += ["unresolved:"] * bool(d["unresolved"]) + [f"  {u['field']}: {u['status']}: {u['reason']}" for u in d["unresolved"]]
    out += [f"warnings: {d['warnings']}"] * bool(d["warnings"])
    m = d["meta"]
    return "\n".join([*out, f"meta: rounds={m['rounds']} pages={m['pages_fetched']} domains={m['sources_consulted']} {m['duration_ms']}ms"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    if args.fixtures:
        index, local = L.fixture_index(spark, args.fixtures), L.fixture_files(spark, args.fixtures)
        tiers = [(host(r["url"]), r["tier"]) for r in index.where("tier is not null").select("url", "tier").collect()]
    else:
        index, local, tiers = spark.createDataFrame([], INDEX), spark.createDataFrame([], "url string, mime string, data binary"), []
    tiers = dict(tiers) | dict.fromkeys(args.tier_a, "A") | dict.fromkeys(args.tier_b, "B")
    connectors = [] if args.offline else [{"name": c} for c in FREE] + [{"name": c, "key": os.environ[v]} for c, v in KEYED.items() if os.environ.get(v)]
    cache = spark.read.parquet(args.cache) if args.cache and os.path.isdir(args.cache) and os.listdir(args.cache) else None
    names = spark.createDataFrame([("0", args.name, args.category)], "product_id string, name string, hint_category string")
    trace: list[str] = []
    frames = resolve(
        spark, names, index, local, mode=args.mode, cache=cache, tiers=spark.createDataFrame(list(tiers.items()), "domain string, tier string"), connectors=connectors,
        pages=None if args.offline else L.get_page, keep=args.cache, seconds=args.seconds, on_round=lambda n, r: trace.append(f"round {n}: {dict(sorted((x['status'], x['count']) for x in r.groupBy('status').count().collect()))}"),
    )
    document = json.loads(frames["documents"].first()["json"])
    if args.json:
        with open(args.json, "w", encoding="utf-8") as f:
            json.dump(document, f, ensure_ascii=False, indent=2)
    print(summary(document))
    if args.trace:
        pages = frames["about"].select("page_ord", "domain", "tier", "entity_match", "match_reason", "page_kind").orderBy("page_ord").collect()
        rejected = frames["rejected"].select("field", "raw", "url", "reject").orderBy("ord").collect()
        trace += [f"page {p['domain']} tier={p['tier']} match={p['entity_match']} ({p['match_reason']}) kind={p['page_kind']}" for p in pages]
        print("\n--- trace ---", *trace, *[f"rejected {r['field']}={r['raw']!r} of {r['url']}: {r['reject']}" for r in rejected], sep="\n")
    cut.clean(spark)
    if own:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
