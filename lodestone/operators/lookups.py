"""Filters, point lookups, ranking and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column has the value."""
    return df.where(F.col(column) == value)


def newest(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order: the largest struct of a partial aggregate, not a window, so that a
    key with very many rows is summed up where it lies."""
    rank = F.struct(*(c for c in order))
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*key, *(F.col("_best")[c].alias(c) for c in rest))


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; ranks stream over the sorted partition (WindowGroupLimit cuts before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with an optional LIMIT and an OFFSET that also works alone."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """A conjunction of optional equality predicates; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def touching(edges: DataFrame, node: object, src: str = "source", dst: str = "target") -> DataFrame:
    """Edges with the node at either end."""
    return edges.where((F.col(src) == node) | (F.col(dst) == node))


def in_directory(path: Column, directory: str) -> Column:
    """Whether a path is the directory or lies below it."""
    return (path == directory) | path.startswith(directory + "/")


def like(column: Column, text: str) -> Column:
    """SQLite's LIKE '%text%': ASCII letters match in either case, % and _ in the text are wildcards."""
    return column.ilike(f"%{text}%")


def difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of left without a partner in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def changed_fields(old: str, new: str, fields: Sequence[str]) -> Column:
    """Names of the fields that differ between two structs, nulls being equal."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields), F.lit(None).cast("string")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, change (added, removed, changed) and the changed fields between two snapshots."""
    a = old.select(F.col(key), F.struct(*fields).alias("_old"))
    b = new.select(F.col(key), F.struct(*fields).alias("_new"))
    both = a.join(b, key, "full_outer").withColumn("_fields", changed_fields("_old", "_new", fields))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size("_fields") > 0, "changed")
    return both.select(key, change.alias("change"), F.when(change == "changed", F.array_join("_fields", ",")).alias("fields")).where("change is not null")
