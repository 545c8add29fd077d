"""Name -> query over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import ATTRIBUTES, UNITS, attribute_specs, synonyms
from ..functions import html as H
from ..functions import text as T
from ..operators import claims as C
from ..operators import copychain, guard, match, vote
from ..operators import understand as U
from ..sources import leads as L
from ..streaming import ledger as S
from . import evaluate as E
from . import resolve as R
from .cut import barrier, folder
from .tables import CELLS, LINE_CLAIMS, line_claims, next_weights_sql, round_sql, supplier_pages, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


text_of = lambda c: F.col(c).cast("string")

# ---- identifiers, numbers, strings ----
_SUM = "list_sum(list_transform(range(1, length({c})), lambda i: CAST(substr({c}, length({c}) - CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))"
_OK = "(length({c}) IN (8, 12, 13, 14) AND (10 - " + _SUM + " % 10) % 10 = CAST(right({c}, 1) AS INTEGER))"


@query(f"""
WITH told AS (SELECT doc_id, text || ' EAN ' || lpad(CAST(doc_id * 37 AS VARCHAR), 12 + CAST(doc_id % 3 AS INTEGER), '4') AS text FROM documents),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS c, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS i FROM told),
good AS (SELECT doc_id, i, CASE WHEN length(c) = 14 AND c[1] = '0' THEN substr(c, 2) WHEN length(c) = 12 THEN '0' || c ELSE c END AS g FROM runs WHERE length(c) IN (8, 12, 13, 14) AND {_OK.format(c="c")}),
once AS (SELECT doc_id, g, min(i) AS i FROM good GROUP BY doc_id, g)
SELECT doc_id, string_agg(g, ',' ORDER BY i) AS gtins FROM once GROUP BY doc_id""")
def gtin_find(spark, sf):
    """Every text, with a code of 12 to 14 digits behind it, of which about a tenth have a right check digit."""
    code = F.lpad((F.col("doc_id") * 37).cast("string"), F.lit(12) + (F.col("doc_id") % 3).cast("int"), F.lit("4"))
    found = table(spark, sf, "documents").select("doc_id", T.find_gtins(F.concat("text", F.lit(" EAN "), code)).alias("g"))
    return found.where(F.size("g") > 0).select("doc_id", F.array_join("g", ",").alias("gtins"))


@query(f"""WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 11 + CAST(p_partkey % 3 AS INTEGER), '7') || CAST(p_size % 10 AS VARCHAR) AS code FROM part)
SELECT p_partkey, code, {_OK.format(c="code")} AS ok, CASE WHEN {_OK.format(c="code")} THEN CASE WHEN length(code) = 12 THEN '0' || code WHEN length(code) = 14 AND code[1] = '0' THEN substr(code, 2) ELSE code END END AS gtin FROM p""")
def gtin_checksum(spark, sf):
    code = F.concat(F.lpad(text_of("p_partkey"), F.lit(11) + (F.col("p_partkey") % 3).cast("int"), F.lit("7")), (F.col("p_size") % 10).cast("string"))
    p = table(spark, sf, "part").select("p_partkey", code.alias("code"))
    return p.select("p_partkey", "code", T.gtin_checksum_ok(F.col("code")).alias("ok"), T.normalize_gtin(F.col("code")).alias("gtin"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, right('00' || CAST(p_partkey % 1000 AS VARCHAR), 3) AS b FROM part)
SELECT p_partkey, CAST(a || b AS DOUBLE) AS grouped, CAST(a || '.' || b AS DOUBLE) AS dotted, CAST(a || '.' || left(b, 2) AS DOUBLE) AS comma, CAST(a || b || '.5' AS DOUBLE) AS german, CAST(a || b || '.5' AS DOUBLE) AS english FROM p""")
def number_parse(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", text_of("p_size").alias("a"), F.right(F.concat(F.lit("00"), (F.col("p_partkey") % 1000).cast("string")), F.lit(3)).alias("b"))
    n = lambda *x: T.parse_number(F.concat(*x))
    a, b, comma, dot = F.col("a"), F.col("b"), F.lit(","), F.lit(".")
    return p.select("p_partkey", n(a, comma, b).alias("grouped"), n(a, dot, b).alias("dotted"), n(a, comma, F.left(b, F.lit(2))).alias("comma"), n(a, dot, b, F.lit(",5")).alias("german"), n(a, comma, b, F.lit(".5")).alias("english"))


@query("""SELECT p_partkey, CAST(round(p_size * 453.592 * 10) AS BIGINT) AS grams, CAST(p_size * 12 AS BIGINT) AS months, CAST(round(p_size * 25.4 * 100) AS BIGINT) AS mm, CAST(p_size * 1024 AS BIGINT) AS gb, CAST(p_size AS BIGINT) AS bare,
CAST(NULL AS BIGINT) AS mismatch, CAST(p_size + 1 AS BIGINT) AS second FROM part""")
def quantity_parse(spark, sf):
    n = text_of("p_size")
    q = lambda text, unit, scale=1: F.round(T.parse_quantity(text, F.lit(unit), normalized=True)["value"] * scale).cast("long")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return table(spark, sf, "part").select(
        "p_partkey", q(say("about ", n, " lb net"), "g", 10).alias("grams"), q(say(n, " years"), "months").alias("months"), q(say(n, " in"), "mm", 100).alias("mm"), q(say(n, " TB"), "GB").alias("gb"),
        q(say("size ", n), "g").alias("bare"), q(say(n, " kg"), "V").alias("mismatch"), q(say("0 - ", (F.col("p_size") + 1).cast("string"), " rpm"), "rpm").alias("second"))


@query("SELECT u.spelling, u.canon, p.p_partkey, round(p.p_size * u.factor, 4) AS value FROM (VALUES " + ", ".join(f"('{s}', '{c}', CAST({f!r} AS DOUBLE))" for s, (c, f) in UNITS.items() if s.isascii() and s.isalpha()) + ") AS u(spelling, canon, factor) CROSS JOIN part p")
def unit_convert(spark, sf):
    """Every part's size in every spelling."""
    rows = [(s, c) for s, (c, _) in UNITS.items() if s.isascii() and s.isalpha()]
    each = F.explode(T.constant([{"spelling": u, "canon": c} for u, c in rows], "array<struct<spelling:string,canon:string>>"))
    p = table(spark, sf, "part").select("p_partkey", "p_size", each.alias("u")).select("p_partkey", "p_size", "u.*")
    return p.select("spelling", "canon", "p_partkey", T.parse_quantity(F.concat(text_of("p_size"), F.lit(" "), "spelling"), F.col("canon"), normalized=True)["value"].alias("value"))



@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name || '--' || p_type || ' / X! ÄGRÖßE Жовтий'), 'ß', 'ss'), '[\\s\\-_/]+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s.]', '', 'g')) AS name FROM part""")
def canonical_string(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.canonical_string(F.concat("p_name", F.lit("--"), "p_type", F.lit(" / X! ÄGRÖßE Жовтий"))).alias("name"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN TRUE WHEN event_type IN ('signup', 'purchase') THEN FALSE END AS included, CASE event_type WHEN 'view' THEN 'brushless' WHEN 'signup' THEN 'brushed' ELSE event_type END AS motor FROM events""")
def bool_enum_normalize(spark, sf):
    said = F.create_map(*[F.lit(x) for x in ("view", "Yes", "click", "Included", "signup", "Not  included", "purchase", "SOLO", "error", "maybe")])
    motor = F.when(F.col("event_type") == "view", "Brushless (EC)").when(F.col("event_type") == "signup", "Carbon-brushed").otherwise(F.col("event_type"))
    e = table(spark, sf, "events").select("event_id", F.try_element_at(said, F.col("event_type")).alias("b"), motor.alias("m"))
    none = F.lit(None).cast("string")
    e = C.with_values(e, F.col("b"), F.lit("bool"), none, F.lit("battery_included"), "x")
    e = C.with_values(e, F.col("m"), F.lit("enum"), none, F.lit("motor_type"), "y")
    return e.select("event_id", F.col("x.bool").alias("included"), F.col("y.str").alias("motor"))


# ---- URLs and pages ----
_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
_QUERY = "array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND split_part(kv, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'tag')), '&')"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_NORM = f"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower({_HOST}) || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"


@query(f"SELECT page_id, {_NORM} AS normal, regexp_replace(lower({_HOST}), '^www\\.', '') AS domain FROM pages")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("normal"), T.domain_of(F.col("url")).alias("domain"))


@query(f"SELECT min(page_id) AS page_id, {_NORM} AS normal FROM pages GROUP BY 2")
def page_dedup(spark, sf):
    each = table(spark, sf, "pages").select(T.domain_of(F.col("url")).alias("product_id"), "page_id", "url")
    return L.first_pages(each, ["page_id"]).select("page_id", T.normalize_url(F.col("url")).alias("normal"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS snapshot FROM documents")
def snapshot_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.snapshot(F.col("text").cast("binary")).alias("snapshot"))


@query()
def html_to_text(spark, sf):
    text = table(spark, sf, "pages").select("page_id", H.html_to_text(F.col("html")).alias("t"))
    return text.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'product' WHEN 2 THEN 'listing' ELSE 'document' END AS kind FROM pages")
def page_kind(spark, sf):
    """Pages as they are, behind a product's data, before four offers to buy, and as files with text only."""
    i, html = F.col("page_id") % 4, F.col("html")
    ld = F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"x"}]}</script>')
    p = table(spark, sf, "pages").select("page_id", F.when(i == 1, F.concat(ld, html)).when(i == 2, F.concat(html, F.lit("<p>Add to cart</p>Add to basket<p>ADD TO CART</p>add to cart"))).when(i == 0, html).alias("html"), F.when(i == 3, html).alias("text"))
    return C.read_pages(p).select("page_id", F.col("page_kind").alias("kind"))


_LD = ("'<html><head><title>t</title><script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"', p_name, '\",\"brand\":{\"name\":\"', p_brand, '\"},\"mpn\":\"', CAST(p_partkey AS STRING), '\",\"weight\":{\"value\":', CAST(p_size AS STRING), ',\"unitText\":\"kg\"},"
       "\"offers\":{\"price\":\"', CAST(p_size AS STRING), ',5\",\"priceCurrency\":\"EUR\",\"availability\":\"https://schema.org/InStock\"},\"additionalProperty\":[{\"name\":\"Type\",\"value\":\"', p_type, '\"}]}</script></head><body><table><tr><th>Size</th><td>', CAST(p_size AS STRING), ' mm</td></tr></table></body></html>'")


def _part_pages(spark, sf):
    return table(spark, sf, "part").withColumn("html", F.expr(f"concat({_LD})"))


@query("SELECT p_partkey, 'Product' AS kind, p_brand AS brand, p_name AS name, CAST(p_partkey AS VARCHAR) AS mpn, CAST(p_size AS VARCHAR) || ' kg' AS weight, p_type AS type FROM part")
def jsonld_extract(spark, sf):
    st = _part_pages(spark, sf).select("p_partkey", H.extract_structured(F.col("html")).alias("s"))
    field = lambda k: F.get(F.filter("s.fields", lambda f: f["k"] == k), F.lit(0))["v"]
    return st.select("p_partkey", "s.kind", "s.identity.brand", "s.identity.name", "s.identity.mpn", field("weight").alias("weight"), field("Type").alias("type"))


@query("SELECT p_partkey, p_size + CAST(0.5 AS DOUBLE) AS price, 'EUR' AS currency, 'InStock' AS availability FROM part")
def offers(spark, sf):
    st = _part_pages(spark, sf).select("p_partkey", F.explode(H.extract_structured(F.col("html"))["offers"]).alias("o"))
    return st.select("p_partkey", "o.price", "o.currency", "o.availability")


@query("""SELECT p_partkey, 1 AS i, 'Weight' AS k, CAST(p_size AS VARCHAR) || ' lb' AS v FROM part UNION ALL SELECT p_partkey, 2, 'Type', p_type FROM part
UNION ALL SELECT p_partkey, 3, 'torque', CAST(p_size AS VARCHAR) || ' Nm' FROM part WHERE p_size % 2 = 0""")
def kv_extract(spark, sf):
    say = F.concat(F.lit("Weight: "), text_of("p_size"), F.lit(" lb\nno pair here\n Type :  "), "p_type", F.lit("\nweight: "), text_of("p_size"), F.lit(" LB\nends in:\n"),
                   F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("it has a torque that is "), text_of("p_size"), F.lit(" Nm"))).otherwise(""))
    pairs = C.extract_kv(table(spark, sf, "part").select("p_partkey", say.alias("text")), ["p_partkey"])
    order = F.when(F.col("k") == "Weight", 1).when(F.col("k") == "Type", 2).otherwise(3)
    return pairs.select("p_partkey", order.alias("i"), "k", "v")


@query("""SELECT l_orderkey, l_linenumber, unnest(['Max. torque hard', 'Max. torque soft']) AS k, unnest([CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' Nm', CAST(CAST(l_quantity AS BIGINT) - 1 AS VARCHAR) || ' Nm']) AS v FROM lineitem WHERE l_linenumber % 2 = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'Torque', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' / ' || CAST(CAST(l_quantity AS BIGINT) - 1 AS VARCHAR) || ' Nm' FROM lineitem WHERE l_linenumber % 2 <> 0""")
def hard_soft_split(spark, sf):
    n = F.col("l_quantity").cast("long")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("pair_ord"), F.when(F.col("l_linenumber") % 2 == 0, "Max. torque (hard/soft)").otherwise("Torque").alias("k"), F.concat(n.cast("string"), F.lit(" / "), (n - 1).cast("string"), F.lit(" Nm")).alias("v"))
    return C.split_hard_soft(l).select("l_orderkey", "l_linenumber", "k", "v")


_KEYS = ["Net weight (approx.)", "Akkuspannung", "weight_g", "The battery capacity", "Farbe", "no such key", "Made in", "RAM"]
_FIELD = {"generic": ["weight_g", None, "weight_g", None, "color", None, "country_of_origin", None], "tools/power_tools": ["weight_g", "voltage_v", "weight_g", "battery_capacity_ah", "color", None, "country_of_origin", None],
          "electronics/smartphones": ["weight_g", None, "weight_g", "battery_mah", "color", None, "country_of_origin", "ram_gb"]}


@query("SELECT p.p_partkey, m.category, m.field FROM part p JOIN (VALUES " + ", ".join(f"({i}, '{c}', '{f}')" for c, own in _FIELD.items() for i, f in enumerate(own) if f) + f") AS m(i, category, field) ON p.p_partkey % {len(_KEYS)} = m.i")
def key_map(spark, sf):
    keys = T.constant(_KEYS, "array<string>")
    pairs = table(spark, sf, "part").select("p_partkey", F.get(keys, (F.col("p_partkey") % len(_KEYS)).cast("int")).alias("k"), F.explode(F.array(*[F.lit(c) for c in ATTRIBUTES])).alias("category"))
    return C.map_keys(pairs, attribute_specs(spark), synonyms(spark)).select("p_partkey", "category", "field")


# ---- understanding and matching ----
@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Bosch' WHEN 1 THEN 'DeWalt' WHEN 2 THEN 'Skf' ELSE 'Brandless' END AS brand, CASE p_partkey % 4 WHEN 0 THEN 'tools/power_tools' WHEN 1 THEN 'tools/power_tools' ELSE 'generic' END AS category,
CAST(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.3 END AS DOUBLE) AS confidence FROM part""")
def brand_category_detect(spark, sf):
    say = F.when(F.col("p_partkey") % 4 == 0, "Акк. шуруповерт BOSCH drill gsr ").when(F.col("p_partkey") % 4 == 1, "grinder De Walt ").when(F.col("p_partkey") % 4 == 2, "skf bearing ").otherwise("x1 Brandless Other ")
    t = table(spark, sf, "part").select("p_partkey", F.concat(say, text_of("p_size")).alias("t"))
    guess = U.detect_category(F.col("t"))
    return t.select("p_partkey", U.detect_brand(F.col("t")).alias("brand"), guess["category"].alias("category"), guess["confidence"].alias("confidence"))


@query("""SELECT p_partkey, 'GSR ' || CAST(10 + p_size AS VARCHAR) || 'V-35 FC' AS model, 'GSR' || CAST(10 + p_size AS VARCHAR) || 'V35FC' AS normal, 'kit=solo' AS variants FROM part""")
def model_extract(spark, sf):
    names = table(spark, sf, "part").select(text_of("p_partkey").alias("product_id"), F.concat(F.lit("Bosch Professional GSR "), (F.col("p_size") + 10).cast("string"), F.lit("V-35 FC solo")).alias("name"))
    u = U.understand(names)
    return u.select(F.col("product_id").cast("long").alias("p_partkey"), "model", F.col("model_normalized").alias("normal"), F.array_join("variant_tokens", ",").alias("variants"))


@query()
def understand_queries(spark, sf):
    p = table(spark, sf, "part").select(text_of("p_partkey").alias("product_id"), F.concat_ws(" ", "p_brand", "p_name", F.concat(F.lit("GSR"), text_of("p_size"), F.lit("V"))).alias("name"))
    return U.anchor_queries(U.understand(p)).select("product_id", "query_ord", "text", "lang")


_CODE = "'GSR' || CAST(10 + p_size AS VARCHAR) || 'V35'"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS i, {_CODE} AS c FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 1 END AS exact, CASE i WHEN 1 THEN c || 'FC' WHEN 2 THEN 'GSB' || substr(c, 4) WHEN 3 THEN left(c, length(c) - 1) ELSE '' END AS siblings,
CAST(CASE i WHEN 0 THEN 0.9 WHEN 1 THEN 0.15 WHEN 2 THEN 0.6 WHEN 3 THEN 0.15 ELSE 0.49 END AS DOUBLE) AS score FROM p""")
def model_presence(spark, sf):
    """Texts with the code itself, a longer, a neighbouring and a shorter one, and the code far down."""
    n = F.concat(F.lit("GSR "), (F.col("p_size") + 10).cast("string"))
    i = F.col("p_partkey") % 5
    text = (F.when(i == 0, F.concat(F.lit("Acme "), n, F.lit("V-35 and again "), n, F.lit("V-35 ."))).when(i == 1, F.concat(F.lit("Acme "), n, F.lit("V-35FC .")))
            .when(i == 2, F.concat(F.lit("Acme "), n, F.lit("V-35 or GSB "), (F.col("p_size") + 10).cast("string"), F.lit("V-35 ."))).when(i == 3, F.concat(F.lit("Acme "), n, F.lit("V-3 .")))
            .otherwise(F.concat(F.repeat(F.lit("far "), 200), n, F.lit("V-35 ."))))
    target = F.concat(F.lit("GSR"), (F.col("p_size") + 10).cast("string"), F.lit("V35"))
    identity = F.from_json(F.lit("{}"), H.STRUCTURED)
    p = table(spark, sf, "part").select("p_partkey", text.alias("text"), target.alias("model_normalized"), target.alias("model"), F.lit("Acme").alias("brand"), F.lit("C").alias("tier"), F.lit(None).cast("string").alias("mpn"), F.array().cast("array<string>").alias("gtins"), identity.alias("st"))
    p = match.entity_match(p).withColumn("m", match.model_presence(F.upper("text"), F.col("model_normalized")))
    return p.select("p_partkey", "m.exact", F.array_join("m.siblings", ",").alias("siblings"), F.col("entity_match").alias("score"))


@query("""WITH k AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS p, s_suppkey % 3 AS i FROM supplier),
sc AS (SELECT *, CASE i WHEN 0 THEN 'MPN' || p WHEN 1 THEN 'MODEL:GSR12V35' ELSE 'OTHER:w' || CAST(s_suppkey AS VARCHAR) || '.example' END AS anchor_key, CAST(CASE i WHEN 0 THEN 0.9 * 0.6 WHEN 1 THEN 0.9 * 0.6 ELSE 0.2 * 0.6 END AS DOUBLE) AS s FROM k),
g AS (SELECT p, anchor_key, sum(s) AS s, count(*) AS n, min(s_suppkey) AS first FROM sc GROUP BY p, anchor_key)
SELECT p AS product_id, anchor_key, CAST(round(s * 1000) AS BIGINT) AS score, n AS pages, row_number() OVER (PARTITION BY p ORDER BY round(s, 9) DESC, first) AS place FROM g""")
def anchor_cluster(spark, sf):
    """Suppliers as candidate pages of their nation: with an mpn, with the model only, with neither."""
    i = F.col("s_suppkey") % 3
    identity = F.from_json(F.when(i == 0, F.concat(F.lit('{"identity":{"mpn":"mpn '), text_of("s_nationkey"), F.lit('"}}'))).otherwise("{}"), H.STRUCTURED)
    s = table(spark, sf, "supplier").select(text_of("s_nationkey").alias("product_id"), F.col("s_suppkey").alias("page_ord"), F.concat(F.lit("https://w"), text_of("s_suppkey"), F.lit(".example/p")).alias("url"), F.concat(F.lit("w"), text_of("s_suppkey"), F.lit(".example")).alias("domain"),
                                            F.when(i == 2, "nothing").otherwise("the GSR 12V-35 drill").alias("text"), F.lit("GSR12V35").alias("model_normalized"), F.lit("C").alias("tier"), identity.alias("st"))
    c = match.anchor_clusters(match.anchor_scores(s))
    return c.select("product_id", "anchor_key", F.round(F.col("score_sum") * 1000).cast("long").alias("score"), F.size("urls").cast("long").alias("pages"), "place")


# ---- leads ----
def _index(spark, sf):
    """One lead for each nation, found by its name; every other one only beside the word review."""
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("lead_ord"), F.concat(F.lit("https://n.example/"), text_of("n_nationkey")).alias("url"), F.lit(None).cast("string").alias("file"), F.lit("C").alias("tier"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet"),
                    F.array("n_name").alias("match_any"), F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit("re-view"))).alias("require_all"), F.array(F.concat(F.lit("id"), text_of("n_nationkey"))).alias("ids"))


_FOLD = "lower(regexp_replace({c}, '[\\s\\-_/\"'']', '', 'g'))"


@query(f"""SELECT s.s_suppkey, n.n_nationkey AS lead FROM supplier s JOIN nation q ON q.n_nationkey = s.s_nationkey
JOIN nation n ON contains({_FOLD.format(c="q.n_name")} || CASE WHEN s.s_suppkey % 3 = 0 THEN 'review' ELSE '' END, {_FOLD.format(c="n.n_name")}) AND (n.n_nationkey % 2 = 0 OR s.s_suppkey % 3 = 0)""")
def lead_search(spark, sf):
    q = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")
    q = q.select("s_suppkey", F.concat(F.lit('"'), "n_name", F.lit('" '), F.when(F.col("s_suppkey") % 3 == 0, "Review").otherwise("")).alias("text"))
    return L.fixture_search(q, _index(spark, sf)).select("s_suppkey", F.col("lead_ord").alias("lead"))


@query("SELECT s_suppkey, s_nationkey AS lead FROM supplier UNION SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE (s_nationkey + 1) % 25 IN (SELECT n_nationkey FROM nation)")
def lead_lookup(spark, sf):
    a = table(spark, sf, "supplier").select(text_of("s_suppkey").alias("product_id"), F.array(F.concat(F.lit("id"), text_of("s_nationkey"))).alias("gtins"), F.concat(F.lit("id"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("mpn"))
    return L.fixture_lookup(a, _index(spark, sf)).select(F.col("product_id").cast("long").alias("s_suppkey"), F.col("lead_ord").alias("lead"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")
def lead_anti(spark, sf):
    seen = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("HTTPS://N.example/"), text_of("s_nationkey"), F.lit("#x")).alias("url"))
    seen = seen.select(T.normalize_url(F.col("url")).alias("u"))
    return _index(spark, sf).withColumn("u", T.normalize_url(F.col("url"))).join(seen, "u", "left_anti").select(F.col("lead_ord").alias("n_nationkey"))


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch(ts) AS tt FROM events),
f AS (SELECT user_id, event_id, k, tt, TRUE AS ok, CASE WHEN event_type = 'error' THEN CASE WHEN 1 >= 2 THEN 0 ELSE 1 END ELSE 0 END AS n, CAST(-1 AS DOUBLE) AS until FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, e.tt, e.tt >= f.until, CASE WHEN e.tt < f.until THEN f.n WHEN e.event_type <> 'error' THEN 0 WHEN f.n + 1 >= 2 THEN 0 ELSE f.n + 1 END,
CASE WHEN e.tt >= f.until AND e.event_type = 'error' AND f.n + 1 >= 2 THEN e.tt + 86400 ELSE f.until END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, ok AS admitted FROM f""")
def circuit_breaker(spark, sf):
    """Users as connectors, errors as failures; two in a row open the breaker for a day."""
    e = table(spark, sf, "events").select(text_of("user_id").alias("connector"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("failed"))
    return L.circuit_breaker(e, 2, 86400.0).select(F.col("ord").alias("event_id"), "admitted")


# ---- copy chains ----
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, unnest(list_zip(w, w[2:], w[3:], w[4:])) AS t FROM w),
s AS (SELECT DISTINCT doc_id, t[1] || ' ' || t[2] || ' ' || t[3] || ' ' || t[4] AS s FROM e WHERE t[4] IS NOT NULL), n AS (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1),
m AS (SELECT a.doc_id, count(*) AS common FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND b.s = a.s GROUP BY 1)
SELECT a.doc_id, a.n AS shingles, CAST(round(1e6 * coalesce(common / CAST(a.n + b.n - common AS DOUBLE), 0)) AS BIGINT) AS jaccard FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN m ON m.doc_id = a.doc_id""")
def shingle_jaccard(spark, sf):
    """Whole texts, each beside the next."""
    worded = barrier(table(spark, sf, "documents").select("doc_id", T.words_in(F.col("text")).alias("w")))
    d = worded.select("doc_id", T.shingles_of(F.col("w")).alias("s"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return d.join(other, "doc_id").select("doc_id", F.size("s").cast("long").alias("shingles"), F.round(T.jaccard(F.col("s"), F.col("t")) * 1e6).cast("long").alias("jaccard"))


@query("""WITH k AS (SELECT CAST(s_nationkey AS VARCHAR) AS p, s_suppkey % 3 AS t, 'https://w' || CAST(s_suppkey AS VARCHAR) || '.example/p' AS url FROM supplier), r AS (SELECT *, min(url) OVER (PARTITION BY p, t) AS root FROM k)
SELECT p AS product_id, url, 'c' || CAST(dense_rank() OVER (PARTITION BY p ORDER BY root) AS VARCHAR) AS cluster FROM r""")
def copy_clusters(spark, sf):
    return copychain.copy_clusters(supplier_pages(spark, sf))


@query("""WITH k AS (SELECT CAST(s_nationkey AS VARCHAR) AS p, s_suppkey % 3 AS t, 'https://w' || CAST(s_suppkey AS VARCHAR) || '.example/p' AS url FROM supplier), r AS (SELECT *, min(url) OVER (PARTITION BY p, t) AS root FROM k)
SELECT p AS product_id, root AS u, url AS v FROM r WHERE url <> root""")
def copy_edges(spark, sf):
    return copychain.copy_edges(copychain.blocks(supplier_pages(spark, sf)))


# ---- filters ----
@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'out of range' WHEN l_linenumber % 3 = 0 THEN 'not grounded in span' END AS reject FROM lineitem""")
def prefilter(spark, sf):
    """Months of warranty: 40 and fewer are within 240 after a factor of six; every third span tells another number."""
    n = F.col("l_quantity").cast("long")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("generic").alias("category"), F.lit("warranty_months").alias("field"), (n * 6).cast("double").alias("num"), F.concat((n * 6).cast("string"), F.lit(" months")).alias("raw"),
                                            F.concat(F.lit("Warranty:  "), F.when(F.col("l_linenumber") % 3 == 0, F.lit("none")).otherwise((n * 6).cast("string")), F.lit("   MONTHS")).alias("span"))
    return C.prefilter(l, attribute_specs(spark), normalized=True).select("l_orderkey", "l_linenumber", "reject")


# ---- voting ----
def _scaled(c, scale=1000):
    return F.round(F.col(c) * scale).cast("long")


@query("WITH " + LINE_CLAIMS.strip() + " SELECT url, CAST(round(w * 2 * coalesce(a, 1) / (coalesce(a, 1) + coalesce(b, 1)) * 1e6) AS BIGINT) AS weight FROM weighed LEFT JOIN (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS d, CAST(3 AS DOUBLE) AS a, CAST(2 AS DOUBLE) AS b FROM supplier WHERE s_suppkey % 2 = 0) USING (d)")
def local_weight(spark, sf):
    ledger = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), text_of("s_suppkey")).alias("domain"), F.lit("generic").alias("category"), F.lit("color").alias("field"), F.lit(3.0).alias("alpha"), F.lit(2.0).alias("beta"))
    return vote.local_weight(line_claims(spark, sf), ledger).select("url", _scaled("base", 1e6).alias("weight"))


def _cells(spark, sf):
    return vote._cells(vote.local_weight(vote.group_claims(line_claims(spark, sf), attribute_specs(spark)), None))


@query("WITH " + CELLS.strip() + round_sql(1) + " SELECT p AS product_id, lower(v) AS name, CAST(round(score * 1e6) AS BIGINT) AS score, votes, CAST(claims AS BIGINT) AS claims FROM g1")
def cluster_score(spark, sf):
    return vote._scores(_cells(spark, sf), None).select("product_id", "name", _scaled("score", 1e6).alias("score"), "votes", "claims")


@query("WITH " + CELLS.strip() + round_sql(1) + " SELECT p AS product_id, lower(winner) AS winner, status, CAST(round(round(confidence, 3) * 1000) AS BIGINT) AS confidence, votes, method FROM dec1")
def vote_winner(spark, sf):
    out = vote.decide(vote._scores(_cells(spark, sf), None))
    return out.select("product_id", "winner", "status", _scaled("confidence").alias("confidence"), "votes", "method")


_FIXPOINT = "WITH " + CELLS.strip() + "".join(round_sql(i) + next_weights_sql(i) for i in range(1, 5)) + round_sql(5)


@query(_FIXPOINT + " SELECT p AS product_id, status, CASE WHEN status <> 'conflict' THEN winner END AS value, CAST(round(round(confidence, 3) * 1000) AS BIGINT) AS confidence, votes AS independent_votes, method FROM dec5")
def truth_discovery(spark, sf):
    out = vote.truth_discovery(line_claims(spark, sf), attribute_specs(spark))
    return out.select("product_id", "status", "value", _scaled("confidence").alias("confidence"), "independent_votes", "method")


@query(_FIXPOINT + " SELECT p AS product_id, d AS domain, CAST(round(weight * 1e6) AS BIGINT) AS weight FROM sw5")
def crh_fixpoint(spark, sf):
    return vote.source_weights(line_claims(spark, sf), attribute_specs(spark)).select("product_id", "domain", _scaled("weight", 1e6).alias("weight"))


@query(_FIXPOINT + """, c AS (SELECT r.p, r.v, r.score / r.total AS share, r.votes, r.claims, x.status, x.winner FROM r5 r JOIN dec5 x USING (p) WHERE x.status = 'conflict' OR r.v <> x.winner)
SELECT p AS product_id, v AS value, CAST(round(round(share, 3) * 1000) AS BIGINT) AS score, CASE WHEN v <> winner THEN 'outvoted (' || votes || ' independent vote' || CASE WHEN votes = 1 THEN '' ELSE 's' END || ' from ' || claims || ' page' || CASE WHEN claims = 1 THEN '' ELSE 's' END || ')'
|| CASE WHEN votes < claims THEN '; pages share an identical spec block (copy-chain)' ELSE '' END END AS reason FROM c""")
def candidates(spark, sf):
    out = vote.truth_discovery(line_claims(spark, sf), attribute_specs(spark))
    c = out.select("product_id", F.explode("candidates").alias("c"))
    return c.select("product_id", "c.value", F.round(F.col("c.score") * 1000).cast("long").alias("score"), F.col("c.rejected_reason").alias("reason"))


@query(_FIXPOINT + " SELECT x.p AS product_id, string_agg(c.url, ',' ORDER BY -c.prior, c.url) AS urls FROM dec5 x JOIN claims c ON c.p = x.p AND c.v = x.winner WHERE x.status <> 'conflict' GROUP BY x.p")
def source_refs(spark, sf):
    out = vote.truth_discovery(line_claims(spark, sf), attribute_specs(spark)).where("status <> 'conflict'")
    return out.select("product_id", F.array_join(F.transform("sources", lambda s: s["url"]), ",").alias("urls"))


@query()
def equivalence_groups(spark, sf):
    """Prices as weights, 3 % alike; their groups and leaders."""
    l = table(spark, sf, "lineitem")
    c = line_claims(spark, sf).withColumn("field", F.lit("weight_g")).withColumn("str", F.lit(None).cast("string")).join(
        l.select(F.concat(F.lit("u"), text_of("l_orderkey"), F.lit("-"), text_of("l_linenumber")).alias("url"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price")), "url")
    g = vote.group_claims(c.withColumn("num", F.col("price") + F.col("ord") % 97).drop("price"), attribute_specs(spark))
    return g.groupBy("product_id", "name").agg(F.count("*").alias("claims"), F.min_by("num", "rank").alias("leader"))


def _agreed(spark, sf):
    return table(spark, sf, "events").select(text_of("user_id").alias("domain"), F.lit("generic").alias("category"), F.col("event_type").alias("field"), (F.col("value") >= 50).cast("long").alias("agree"), (F.col("value") < 50).cast("long").alias("disagree"))


_LEDGER = """SELECT CAST(user_id AS VARCHAR) AS domain, event_type AS field, 1 + CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS DOUBLE) + {a} AS alpha, 1 + CAST(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS DOUBLE) AS beta FROM events GROUP BY user_id, event_type"""


@query(_LEDGER.format(a="CASE WHEN event_type = 'view' THEN 2 ELSE 0 END"))
def ledger_update(spark, sf):
    old = table(spark, sf, "events").where("event_type = 'view'").select(text_of("user_id").alias("domain"), F.lit("generic").alias("category"), F.col("event_type").alias("field"), F.lit(3.0).alias("alpha"), F.lit(1.0).alias("beta")).distinct()
    return vote.update_ledger(old, _agreed(spark, sf)).select("domain", "field", "alpha", "beta")


@query(_LEDGER.format(a="0"))
def stream_ledger(spark, sf):
    """The same counts as a stream over the table's files."""
    batch = table(spark, sf, "events")
    files = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet" if not sf.startswith("viewfs") else "*.parquet")
    stream = files.parquet(sf)
    seen = stream.select(text_of("user_id").alias("domain"), F.lit("generic").alias("category"), F.col("event_type").alias("field"), (F.col("value") >= 50).cast("long").alias("agree"), (F.col("value") < 50).cast("long").alias("disagree"))
    return S.run_to_end(spark, seen, f"{folder(spark)}/stream-{uuid.uuid4().hex}").select("domain", "field", "alpha", "beta")


@query(_FIXPOINT + """, h AS (SELECT p, 'color' AS field, 0.6 * (1 - round(confidence, 3)) AS pr, 4 AS o FROM dec5 WHERE status <> 'verified'
UNION ALL SELECT p, s.field, s.w, s.o FROM dec5, (VALUES """ + ", ".join(f"('{a['key']}', CAST({a['weight']} AS DOUBLE), {i})" for i, a in enumerate(ATTRIBUTES["generic"]) if a["key"] != "color") + """) AS s(field, w, o)),
k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY pr DESC, o) AS hole_rank FROM h) SELECT p AS product_id, field, hole_rank FROM k WHERE hole_rank <= 10""")
def holes_topk(spark, sf):
    claims = line_claims(spark, sf)
    products = claims.select("product_id", "category").distinct()
    return vote.holes(vote.truth_discovery(claims, attribute_specs(spark)), products, attribute_specs(spark))


@query(_FIXPOINT + " SELECT a.p AS product_id, CAST(round(abs(round(a.confidence, 3) - round(b.confidence, 3)) * 1000) AS BIGINT) AS gain FROM dec5 a JOIN dec1 b USING (p)")
def gain(spark, sf):
    claims, specs = line_claims(spark, sf), attribute_specs(spark)
    before, after = vote.truth_discovery(claims, specs, rounds=1), vote.truth_discovery(claims, specs)
    return vote.gain(before, after).select("product_id", _scaled("gain").alias("gain"))


# ---- guards ----
def _resolved(spark, sf):
    """Parts with a hard and a soft torque, the soft one too high for every third."""
    p = table(spark, sf, "part").select(text_of("p_partkey").alias("product_id"), F.lit("tools/power_tools").alias("category"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 3 == 0).alias("high"))
    refs = F.from_json(F.lit('[{"url":"u1"}]'), R._SOURCES)
    cands = F.from_json(F.lit("[]"), "array<struct<value:string,unit:string,score:double,sources:array<string>,rejected_reason:string>>")
    one = lambda field, n: p.select("product_id", F.lit(field).alias("field"), F.lit("verified").alias("status"), F.lit(0.9).alias("confidence"), n.cast("string").alias("value"), n.alias("num"), F.lit("Nm").alias("unit"), cands.alias("candidates"), refs.alias("sources"))
    size = F.col("size")
    return one(guard.HARD, size).unionByName(one(guard.SOFT, F.when(F.col("high"), size + 1).otherwise(size)))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS product_id, f.field, CASE WHEN p_partkey % 3 = 0 THEN 'conflict' ELSE 'verified' END AS status, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0.4 ELSE 0.9 END AS DOUBLE) AS confidence, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS num
FROM part, (VALUES ('max_torque_hard_nm'), ('max_torque_soft_nm')) AS f(field)""")
def cross_field(spark, sf):
    return guard.cross_field(_resolved(spark, sf)).select("product_id", "field", "status", "confidence", "num")


_ALL = ATTRIBUTES["tools/power_tools"]


@query("SELECT CAST(p_partkey AS VARCHAR) AS product_id, f.field, CASE WHEN f.own THEN 'conflict' ELSE 'unknown' END AS status FROM part, (VALUES " + ", ".join(f"('{a['section']}.{a['key']}', {a['key'] in (guard.HARD, guard.SOFT)})" for a in _ALL) + ") AS f(field, own) WHERE NOT f.own OR p_partkey % 3 = 0")
def unresolved(spark, sf):
    checked = guard.cross_field(_resolved(spark, sf)).drop("warning")
    products = table(spark, sf, "part").select(text_of("p_partkey").alias("product_id"), F.lit("tools/power_tools").alias("category"))
    return guard.unresolved(guard.with_unknown(checked, products, attribute_specs(spark))).select("product_id", "field", "status")


@query("SELECT CAST(p_partkey AS VARCHAR) AS product_id, f.field, 'conflict without two candidates' AS broken FROM part, (VALUES ('max_torque_hard_nm'), ('max_torque_soft_nm')) AS f(field) WHERE p_partkey % 3 = 0")
def schema_violations(spark, sf):
    """Conflicts that the cross-field guard made keep their candidates, and so can break the contract."""
    checked = guard.cross_field(_resolved(spark, sf)).drop("warning")
    products = table(spark, sf, "part").select(text_of("p_partkey").alias("product_id"), F.lit("tools/power_tools").alias("category"))
    return guard.violations(guard.with_unknown(checked, products, attribute_specs(spark))).select("product_id", "field", F.array_join("broken", "; ").alias("broken"))


# ---- evaluation ----
@query("""WITH l AS (SELECT DISTINCT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)), f AS (SELECT l.*, n_chars, quality = 1 AS has FROM l JOIN documents d USING (doc_id)),
s AS (SELECT count(*) AS items, sum(CASE WHEN has THEN 1 ELSE 0 END) AS covered, sum(CASE WHEN has AND toxic = 0 THEN 1 ELSE 0 END) AS verified_total, sum(CASE WHEN has AND toxic = 0 AND doc_id % 10 <> 0 THEN 1 ELSE 0 END) AS verified_correct,
sum(CASE WHEN has AND toxic = 1 THEN 1 ELSE 0 END) AS single_total, sum(CASE WHEN has AND doc_id % 10 = 0 THEN 1 ELSE 0 END) AS forbidden_hits FROM f)
SELECT items, CAST(covered AS BIGINT) AS covered, CAST(verified_total AS BIGINT) AS verified_total, CAST(verified_correct AS BIGINT) AS verified_correct, CAST(single_total AS BIGINT) AS single_total, CAST(forbidden_hits AS BIGINT) AS forbidden_hits, CAST(0 AS BIGINT) AS fabricated,
forbidden_hits = 0 AND verified_correct = verified_total AS gate FROM s""")
def eval_metrics(spark, sf):
    """Labelled documents as items: their size is the field, every tenth answer doubles it, which is forbidden."""
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic").distinct().join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    size = F.col("n_chars").cast("double")
    said = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 10 == 0, size * 2).otherwise(size).cast("string"))
    at = [F.col("doc_id").alias("id"), F.lit("core.size").alias("path")]
    fields = l.select(*at, said.alias("value"), F.when(F.col("toxic") == 0, "verified").otherwise("single_source").alias("status"), F.array(F.lit("size 5")).alias("raw"), F.array(F.lit("its size 5 mm")).alias("snippets"))
    truths, bad = l.select(*at, size.cast("string").alias("truth")), l.select(*at, (size * 2).cast("string").alias("truth"))
    none = fields.select("id", "path", F.col("status").alias("truth")).where("false")
    scores = E.score(fields, fields.select("id", "path", "value").where("false"), truths, bad, none, none)
    return E.metrics(scores).select("items", "covered", "verified_total", "verified_correct", "single_total", "forbidden_hits", "fabricated", "gate")


# ---- everything ----
_SITES = [("maker.example", "A", 0), ("facts.example", "B", 0), ("shop.example", "C", 1)]


def _part_web(spark, sf):
    """Names, index and pages of all parts: three pages each, one of them with a weight of its own."""
    p = table(spark, sf, "part").select(text_of("p_partkey").alias("product_id"), F.concat(F.lit("GSR "), F.col("p_partkey") + 100, F.lit("V-35")).alias("m"), "p_size")
    names = p.select("product_id", F.concat(F.lit("Bosch "), "m", F.lit(" solo drill")).alias("name"))
    site = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(t).alias("t"), F.lit(x).alias("x")) for d, t, x in _SITES]))
    each = p.select("product_id", "m", "p_size", site.alias("s"))
    url = F.concat(F.lit("https://"), "s.d", F.lit("/"), "product_id")
    html = F.concat(F.lit("<html><body><h1>Bosch "), "m", F.lit("</h1><table><tr><td>Weight</td><td>"), (F.col("p_size") + F.col("s.x") * 50).cast("string"), F.lit(" kg</td></tr><tr><td>Voltage</td><td>12 V</td></tr><tr><td>Max. torque (hard/soft)</td><td>35 / 20 Nm</td></tr></table></body></html>"))
    index = each.select(F.col("product_id").cast("int").alias("lead_ord"), url.alias("url"), F.lit(None).cast("string").alias("file"), F.col("s.t").alias("tier"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet"), F.array("m").alias("match_any"), F.lit(None).cast("array<string>").alias("require_all"), F.lit(None).cast("array<string>").alias("ids"))
    return names, index, each.select(url.alias("url"), F.lit("text/html").alias("mime"), html.cast("binary").alias("data"))


# A maker's page and a catalogue state the same block of facts, so they are one vote of two claims; a shop has another
# weight.  After the first vote the sources weigh by their right facts: four of four, and three.
@query("""WITH f(field, agreed) AS (VALUES ('weight_g', FALSE), ('voltage_v', TRUE), ('max_torque_hard_nm', TRUE), ('max_torque_soft_nm', TRUE)),
w AS (SELECT 1.0 * (1 + 0.1 * ln(2)) * 2 * (1 + 4) / CAST(2 + 4 AS DOUBLE) AS won, 0.45 * 2 * (1 + 3) / CAST(2 + 4 AS DOUBLE) AS lost), c AS (SELECT 0.5 + 0.5 * (won - lost) / (won + lost) AS conf FROM w)
SELECT CAST(p_partkey AS VARCHAR) AS product_id, f.field, 'verified' AS status, CAST(round(CASE WHEN agreed THEN 0.99 ELSE greatest(conf, 0.86) END * 1000) AS BIGINT) AS confidence,
CASE f.field WHEN 'weight_g' THEN CAST(p_size * 1000 AS VARCHAR) WHEN 'voltage_v' THEN '12' WHEN 'max_torque_hard_nm' THEN '35' ELSE '20' END AS value, CASE WHEN agreed THEN 2 ELSE 1 END AS independent_votes FROM part, f, c""")
def resolve_products(spark, sf):
    """Names to resolved attributes over the pages of all parts."""
    out = R.resolve(spark, *_part_web(spark, sf), now="2026-01-01T00:00:00Z")["resolved"]
    return out.where("status <> 'unknown'").select("product_id", "field", "status", _scaled("confidence").alias("confidence"), "value", F.col("independent_votes").cast("int").alias("independent_votes"))


@query(f"""WITH p AS (SELECT page_id, {_NORM} AS u, url, html FROM pages), l AS (SELECT u, max(html) AS html, max(page_id) AS last, page_id % 2 AS odd FROM p GROUP BY u, page_id % 2)
SELECT p.page_id, 'text/html' AS mime, 'sha256:' || sha256((SELECT l.html FROM l WHERE l.u = p.u ORDER BY odd LIMIT 1)) AS snapshot FROM p""")
def page_rejoin(spark, sf):
    """Pages met by their normal URLs: wanted with tracking parameters and capital hosts, half of them cached only."""
    p = table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("u"), F.col("html").cast("binary").alias("data"))
    wanted = p.select("page_id", F.concat(F.col("u"), F.when(F.col("u").contains("?"), "&").otherwise("?"), F.lit("utm_source=x#top")).alias("url"))
    local = p.where("page_id % 2 = 0").select(F.col("u").alias("url"), F.lit("text/html").alias("mime"), "data")
    cache = p.where("page_id % 2 = 1").select(F.sha2("u", 256).alias("key"), F.col("u").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("mime"), F.hex("data").alias("data"))
    return L.fetch(wanted, local, cache).select("page_id", "mime", L.snapshot(F.col("data")).alias("snapshot"))
