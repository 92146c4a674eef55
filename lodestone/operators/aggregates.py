"""Aggregates: status and coverage reports, insight ladders, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(files: DataFrame, *keys: str) -> DataFrame:
    """Counts of GREEN, YELLOW and RED in one pass."""
    return files.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("GREEN", "YELLOW", "RED")))


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one decimal as text, '0.0' of nothing."""
    return F.when(whole == 0, "0.0").otherwise(F.format_string("%.1f", F.floor(part * 1000 / whole + 0.5) / 10))


def insights_of(files: DataFrame) -> DataFrame:
    """Rows (filepath, category, severity) by the ladder of file insights: several can hold for one file."""
    red, yellow, green = (F.col("status") == s for s in ("RED", "YELLOW", "GREEN"))
    row = lambda c, category, severity: F.when(c, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    ladder = F.array_compact(
        F.array(
            row(red & (F.col("impact") == 0), "orphan", "error"),
            row(red & (F.col("impact") > 0), "broken", "error"),
            row(yellow, "under-connected", "warning"),
            row(green & (F.col("reach") < 0.3), "under-imported", "warning"),
            row(F.col("impact") > 20, "high-impact", "info"),
        )
    )
    return files.select("filepath", F.inline(ladder))


def risk_band(reach: Column, stability: Column, fragility: Column, conflicts: Column) -> tuple[Column, Column]:
    """Risk score (1 - reach) + (1 - stability) + fragility + conflicts / 10, and its band."""
    score = (1 - reach) + (1 - stability) + fragility + conflicts * 0.1
    return score, F.when(score < 0.2, "low").when(score < 0.6, "medium").when(score < 1.0, "high").otherwise("critical")


def dependency_weight(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """For every export name, how many imports name it as a whole part of their path (split at / . and -).

    Instead of a substring test of every pair, the parts of a path are exploded and joined by
    equality, so that no pair is formed that does not match.
    """
    parts = imports.select(F.explode(F.array_distinct(F.split("source", "[/.-]"))).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("weight"))
    return exports.join(parts, "name", "left").select("name", F.coalesce("weight", F.lit(0)).alias("weight"))


def verify(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """filepath, state: MISSING, ORPHAN, MODIFIED or VERIFIED, from two tables (filepath, sha)."""
    both = registry.withColumnRenamed("sha", "_want").join(disk.withColumnRenamed("sha", "_have"), "filepath", "full_outer")
    state = F.when(F.col("_have").isNull(), "MISSING").when(F.col("_want").isNull(), "ORPHAN").when(F.col("_want") != F.col("_have"), "MODIFIED").otherwise("VERIFIED")
    return both.select("filepath", state.alias("state"))
