"""Gap analysis over schema cards: six dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.aggregates import percent


def _real_purpose():
    return ~F.trim(F.coalesce(F.col("intent.purpose"), F.lit(""))).isin("", "(not set)")


def phases(cards: DataFrame) -> DataFrame:
    """phase, n, can_progress: files with an intent (a purpose or a value statement that is not empty) that are not in PRODUCTION."""
    phase = F.coalesce(F.nullif("lifecyclePhase", F.lit("")), F.lit("UNKNOWN"))
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    ready = (said("intent.purpose") | said("intent.valueStatement")) & (phase != "PRODUCTION")
    return cards.groupBy(phase.alias("phase")).agg(F.count("*").alias("n"), F.count_if(ready).alias("can_progress"))


def statuses(cards: DataFrame) -> DataFrame:
    """status, n, and causes: no_exports and no_importers of RED, low_reach of GREEN."""
    red = F.col("status") == "RED"
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return cards.groupBy("status").agg(F.count("*").alias("n"), F.count_if(red & none("exports")).alias("no_exports"), F.count_if(red & none("connections.importedBy")).alias("no_importers"), F.count_if((F.col("status") == "GREEN") & (F.col("reachabilityScore") < 0.3)).alias("low_reach"))


def intent_coverage(cards: DataFrame) -> DataFrame:
    """dir, total, with_intent, coverage (percent as text)."""
    g = cards.groupBy(F.split_part("filepath", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count("*").alias("total"), F.count_if(_real_purpose()).alias("with_intent"))
    return g.withColumn("coverage", percent(F.col("with_intent"), F.col("total")))


def export_coverage(cards: DataFrame) -> DataFrame:
    """with_exports, without_exports, cjs and es6 (files with such imports)."""
    has = F.coalesce(F.size("exports"), F.lit(0)) > 0
    kind = lambda *k: F.coalesce(F.exists("imports", lambda x: x["importType"].isin(*k)), F.lit(False))
    return cards.agg(F.count_if(has).alias("with_exports"), F.count_if(~has).alias("without_exports"), F.count_if(kind("require")).alias("cjs"), F.count_if(kind("import", "default", "named", "namespace", "side-effect", "dynamic")).alias("es6"))


def connection_totals(cards: DataFrame) -> DataFrame:
    """imports, resolved, orphan, isolated."""
    targets = cards.select(F.explode("connections.imports").alias("fingerprint"))
    known = cards.select("fingerprint", F.lit(1).alias("_hit")).distinct()
    totals = targets.join(known, "fingerprint", "left").agg(F.count("*").alias("imports"), F.count("_hit").alias("resolved"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    alone = cards.agg(F.count_if(empty("connections.imports") & empty("connections.importedBy")).alias("isolated"))
    return totals.join(alone).withColumn("orphan", F.col("imports") - F.col("resolved"))  # one row each


def module_coverage(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """module, present for wanted modules (module): whether a card's path ends in it."""
    names = cards.select(F.regexp_extract("filepath", "[^/]*$", 0).alias("module"), F.lit(True).alias("present")).distinct()
    return wanted.join(names, "module", "left").select("module", F.coalesce("present", F.lit(False)).alias("present"))
