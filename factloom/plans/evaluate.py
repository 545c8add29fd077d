"""Scores documents against a golden set, and flat baseline answers likewise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_string, grounded

#: Relative difference at which two numbers are the same, whatever the attribute.
TOLERANCE = 0.03


def golden_items(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, hints, identity, path, truth, forbidden, expected_status) exploded from JSON lines; blank lines go."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    text = lambda p: F.expr(f"cast(variant_get(v, '{p}') as string)")
    return lines.select(text("$.id").alias("id"), text("$.name").alias("name"), text("$.expected.fields").alias("fields"), text("$.expected.forbidden").alias("forbidden"), text("$.expected.expected_status").alias("expected_status"), text("$.expected.identity").alias("identity"))


def entries(items: DataFrame, column: str, value: str = "string") -> DataFrame:
    """(id, path, truth) of a JSON object column."""
    return items.select("id", F.explode(F.from_json(column, f"map<string,{value}>")).alias("path", "truth"))


def baseline_answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, value) of ``{id, fields}`` lines; of lines with one id the last counts, keys with _ are notes."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    rows = lines.select("n", F.get_json_object("value", "$.id").alias("id"), F.from_json(F.get_json_object("value", "$.fields"), "map<string,string>").alias("f"))
    last = rows.groupBy("id").agg(F.max_by("f", "n").alias("f"))
    return last.select("id", F.explode("f").alias("path", "value")).where(~F.col("path").startswith("_"))


def same(a: Column, b: Column) -> Column:
    """Of two values as text: numbers within 3 %, lists with equal items, else equal canonical text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y), F.lit(1e-9))
    xs, ys = F.from_json(a, "array<string>"), F.from_json(b, "array<string>")
    lists = a.startswith("[") & b.startswith("[")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), near).when(lists, F.array_sort(xs) == F.array_sort(ys)).otherwise(canonical_string(a) == canonical_string(b)), F.lit(False))


def score(fields: DataFrame, identity: DataFrame, truths: DataFrame, forbidden: DataFrame, statuses: DataFrame, identities: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row of counters for each item: of ``items`` (id), or of every id that something is expected of.  An item
    of whose identity nothing is expected counts as found.

    ``fields``: id, path, value, status, raw, snippets; ``truths``: id, path, truth; ``forbidden``: id, path,
    truth (one row a bad value); ``statuses``: id, path, truth; ``identity`` and ``identities``: id, path, value/truth.
    """
    told = truths.join(fields, ["id", "path"], "left").withColumn("ok", same(F.col("value"), F.col("truth")) & F.col("value").isNotNull())
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    covered = F.col("value").isNotNull()
    is_ = lambda s: covered & (F.col("status") == s)
    a = told.groupBy("id").agg(
        F.count("*").alias("fields_expected"), count(covered).alias("covered"), count(is_("verified")).alias("verified_total"), count(is_("verified") & F.col("ok")).alias("verified_correct"),
        count(is_("single_source")).alias("single_total"), count(is_("single_source") & F.col("ok")).alias("single_correct"))
    proof = fields.where("value is not null").select("id", "path", F.explode_outer("raw").alias("r"), "snippets").select("id", "path", "r", F.explode_outer("snippets").alias("s"))
    proof = proof.groupBy("id", "path").agg(F.max(F.coalesce(grounded(F.col("r"), F.col("s")), F.lit(False))).alias("g"))
    b = proof.groupBy("id").agg(F.count("*").alias("values_total"), count(~F.col("g")).alias("fabricated"))
    hits = fields.where("value is not null").join(forbidden, ["id", "path"]).where(same(F.col("value"), F.col("truth")))
    c = hits.groupBy("id").agg(F.count("*").alias("forbidden_hits"))
    d = statuses.join(fields.select("id", "path", "status"), ["id", "path"], "left").groupBy("id").agg(F.count("*").alias("status_expected"), count(F.col("status") == F.col("truth")).alias("status_ok"))
    e = identities.join(identity, ["id", "path"], "left").groupBy("id").agg(F.min(same(F.col("value"), F.col("truth")).cast("long")).alias("entity_ok"))
    out = (items if items is not None else truths.select("id").union(identities.select("id")).union(statuses.select("id")).union(forbidden.select("id"))).select("id").distinct()
    for part in (a, b, c, d, e):
        out = out.join(part, "id", "left")
    return out.fillna(1, ["entity_ok"]).fillna(0)


COUNTERS = ["entity_ok", "fields_expected", "covered", "verified_total", "verified_correct", "single_total", "single_correct", "fabricated", "values_total", "forbidden_hits", "status_expected", "status_ok"]


def metrics(scores: DataFrame) -> DataFrame:
    """Sums over items, ratios (null without a denominator), and whether the blocking gate holds."""
    sums = scores.agg(F.count("*").alias("items"), *[F.sum(c).alias(c) for c in COUNTERS])
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return sums.withColumns({
        "entity_accuracy": rate("entity_ok", "items"), "verified_precision": rate("verified_correct", "verified_total"), "single_precision": rate("single_correct", "single_total"),
        "fabrication_rate": rate("fabricated", "values_total"), "coverage": rate("covered", "fields_expected"), "status_accuracy": rate("status_ok", "status_expected"),
        "gate": (F.col("fabricated") == 0) & (F.col("forbidden_hits") == 0) & (F.col("verified_correct") == F.col("verified_total")),
    })


def score_baseline(answers: DataFrame, truths: DataFrame, forbidden: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """(id, fields_expected, covered, correct, forbidden_hits, entity_ok) of each item of which something is expected:
    every answer counts as an assertion; ``identities`` (id, path, truth) are answered at identity.path."""
    told = truths.join(answers, ["id", "path"], "left")
    ok = F.col("value").isNotNull() & same(F.col("value"), F.col("truth"))
    a = told.groupBy("id").agg(F.count("*").alias("fields_expected"), F.count("value").alias("covered"), F.sum(ok.cast("long")).alias("correct"))
    hits = answers.join(forbidden, ["id", "path"]).where(same(F.col("value"), F.col("truth"))).select("id", "path").distinct()
    ids = truths.select("id").union(forbidden.select("id"))
    entity = None
    if identities is not None:
        named = identities.select("id", F.concat(F.lit("identity."), "path").alias("path"), "truth").join(answers, ["id", "path"], "left")
        entity = named.groupBy("id").agg(F.min(ok.cast("long")).alias("entity_ok"))
        ids = ids.union(identities.select("id"))
    out = ids.distinct().join(a, "id", "left").join(hits.groupBy("id").agg(F.count("*").alias("forbidden_hits")), "id", "left")
    out = out.join(entity, "id", "left") if entity is not None else out.withColumn("entity_ok", F.lit(1).cast("long"))
    return out.fillna(1, ["entity_ok"]).fillna(0)
