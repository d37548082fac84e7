"""Scheme discovery: attributes of a question against tables of cited rules.

rules: code, kind (applicability, disqualifying, boost), rule_idx, attribute, values; schemes: code, always_include; required: code, idx, attribute, why.
The rule tables are hand-written and small: they are broadcast by their size, and each question meets them by attribute, not by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx

#: The bound that makes broadcasting the scheme table safe; it is checked.
MAX_SCHEMES = 10_000
ATTRIBUTES = ("has_land", "occupation", "land_holding", "category", "gender", "region", "crop_group")


def extract_attributes(queries: DataFrame) -> DataFrame:
    """query_id, one column for each attribute, interests, intent, any_explicit."""
    q = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(q)
    named = tx.land_holding(low)
    landless = F.contains(low, F.lit("landless")) | F.contains(low, F.lit("no land"))
    farmer = low.rlike("farmer|kisan|farming")
    out = queries.select(
        "query_id", F.when(landless, "false").when(named != "unknown", "true").otherwise("unknown").alias("has_land"), F.when(farmer | (named != "unknown"), "farmer").otherwise("unknown").alias("occupation"), named.alias("land_holding"),
        tx.first_pattern(q, fx.CATEGORY).alias("category"), tx.first_pattern(q, fx.GENDER).alias("gender"), tx.first_keyword(low, fx.REGION).alias("region"), tx.first_keyword(low, fx.CROPS).alias("crop_group"),
        tx.interests(low).alias("interests"), tx.asks_for_schemes(q).alias("intent"),
    )
    explicit = F.size("interests") > 0
    for a in ATTRIBUTES:
        explicit = explicit | (F.col(a) != "unknown")
    return out.withColumn("any_explicit", explicit)


def facts(attributes: DataFrame) -> DataFrame:
    """query_id, attribute, value: one row for each value; interests give one for each tag, or unknown."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ATTRIBUTES))
    tags = F.transform(F.when(F.size("interests") > 0, F.col("interests")).otherwise(F.array(F.lit("unknown"))), lambda t: F.struct(F.lit("interests").alias("attribute"), t.alias("value")))
    return attributes.select("query_id", F.explode(F.concat(pairs, tags)).alias("f")).select("query_id", "f.*")


def match_schemes(attributes: DataFrame, rules: DataFrame, schemes: DataFrame) -> DataFrame:
    """query_id, code, boost_hits, rank: no disqualifier fires, and all applicability rules pass, or the scheme is always included and nothing is explicit.

    An attribute that isn't extracted has the value unknown.
    """
    known = facts(attributes)
    accepted = rules.select("code", "kind", "rule_idx", "attribute", F.explode("values").alias("value"))
    fired = known.join(accepted, ["attribute", "value"]).groupBy("query_id", "code", "kind", "rule_idx").agg(F.max((F.col("value") != "unknown").cast("int")).alias("explicit"))
    outside = accepted.where((F.col("value") == "unknown") & ~F.col("attribute").isin(*ATTRIBUTES, "interests")).select("code", "kind", "rule_idx").distinct()
    per = fired.groupBy("query_id", "code").agg(F.count_if(F.col("kind") == "disqualifying").alias("bad"), F.count_if(F.col("kind") == "applicability").alias("passed"), F.count_if((F.col("kind") == "boost") & (F.col("explicit") == 1)).alias("boost_hits"))
    need = schemes.join(rules.groupBy("code").agg(F.count_if(F.col("kind") == "applicability").alias("need")), "code", "left").join(outside.groupBy("code").agg(F.count_if(F.col("kind") == "applicability").alias("free"), F.count_if(F.col("kind") == "disqualifying").alias("always_bad")), "code", "left")
    if need.count() > MAX_SCHEMES:
        raise ValueError(f"more than {MAX_SCHEMES} schemes: the table is meant to be written by hand")
    pairs = attributes.select("query_id", "any_explicit").join(F.broadcast(need)).join(per, ["query_id", "code"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ok = (zero("bad") + zero("always_bad") == 0) & ((zero("passed") + zero("free") == zero("need")) | (F.col("always_include") & ~F.col("any_explicit")))
    hits = pairs.where(ok).select("query_id", "code", zero("boost_hits").alias("boost_hits"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("boost_hits").desc(), F.col("code"))))


def missing_information(matches: DataFrame, required: DataFrame, attributes: DataFrame) -> DataFrame:
    """query_id, attribute, why: required attributes that are unknown, with the reason of the first scheme that asks."""
    known = facts(attributes).where("value <> 'unknown'").select("query_id", "attribute").distinct()
    asked = matches.join(required, "code").groupBy("query_id", "attribute").agg(F.min_by("why", F.struct("rank", "idx")).alias("why"))
    return asked.join(known, ["query_id", "attribute"], "left_anti")


def match_reasons(matches: DataFrame, attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """query_id, code, kind, rule_idx, attribute, matched: why a scheme was matched, by rules of applicability and boosts that something known about the person meets.

    matched is the value, or the interests that the rule accepts, sorted and joined by commas. A rule that only the lack of knowledge meets is no reason.
    Columns that the rules have of a source (filename, page, note) go along: they are the citation of the reason.
    """
    cited = [c for c in ("filename", "page", "note") if c in rules.columns]
    accepted = rules.where("kind <> 'disqualifying'").select("code", "kind", "rule_idx", "attribute", F.explode("values").alias("value"), *cited)
    met = matches.select("query_id", "code").join(facts(attributes).where("value <> 'unknown'"), "query_id").join(accepted, ["code", "attribute", "value"])
    return met.groupBy("query_id", "code", "kind", "rule_idx", "attribute").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("matched"), *(F.first(c).alias(c) for c in cited))
