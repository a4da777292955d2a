"""Join-shaped operators: coverage-checked joins, splits by ids, map fills and merge policies.

None of them forces a broadcast: small sides are found by size, and hot keys are split by the
adaptive planner. Where the reference semantics is "first" or "last", an order column decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem) of keys that keep two tables from joining one to one.

    Problems: blank_left, blank_right, repeated_left, repeated_right, only_left, only_right.
    """
    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias(f"n_{side}"))

    blank = (F.coalesce(F.trim("key"), F.lit("")) == "")
    both = counted(left, "left").join(counted(right, "right"), "key", "full_outer").fillna(0, ["n_left", "n_right"])
    problems = F.array_compact(F.array(
        F.when(blank & (F.col("n_left") > 0), "blank_left"), F.when(blank & (F.col("n_right") > 0), "blank_right"),
        F.when(~blank & (F.col("n_left") > 1), "repeated_left"), F.when(~blank & (F.col("n_right") > 1), "repeated_right"),
        F.when(~blank & (F.col("n_right") == 0), "only_left"), F.when(~blank & (F.col("n_left") == 0), "only_right"),
    ))
    return both.select("key", F.explode(problems).alias("problem"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join; raises ValueError where coverage_problems finds any."""
    found = coverage_problems(left, right, key).groupBy("problem").count().collect()
    if found:
        raise ValueError(f"not one to one on {key}: " + ", ".join(f"{r['problem']} {r['count']}" for r in sorted(found)))
    return left.join(right, key)


def split_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, the others); null keys belong to the others."""
    listed = ids.select(key).distinct()
    return df.join(listed, key, "left_semi"), df.join(listed, key, "left_anti")


def missing_references(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Listed keys that the table lacks; must be empty for a valid list."""
    return ids.select(key).distinct().join(df, key, "left_anti")


def fill_from_map(df: DataFrame, key: str, target: str, mapping: DataFrame, source: str | None = None) -> DataFrame:
    """``target`` filled where null from a (key, target) table with one row a key; ``source`` marks fills."""
    side = mapping.select(F.col(key), F.col(target).alias("_fill"))
    out = df.join(side, key, "left")
    filled = F.col(target).isNull() & F.col("_fill").isNotNull()
    if source:
        out = out.withColumn(f"{target}_source", F.when(filled, source).otherwise(F.when(F.col(target).isNotNull(), "original")))
    return out.withColumn(target, F.coalesce(target, "_fill")).drop("_fill")


def last_by_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of each key that is greatest in order, rows without an order last; combined on the map side."""
    one = df.groupBy(*key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order.isNotNull(), order)).alias("_row"))
    return one.select("_row.*")


def is_missing(c: Column, kind: str) -> Column:
    """Null, blank text and empty collections are missing; 0 and False are not."""
    if kind == "string":
        return F.coalesce(F.trim(c), F.lit("")) == ""
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def merge_nonempty(base: DataFrame, updates: DataFrame, key: str, overwrite: set[str] = frozenset()) -> DataFrame:
    """Keyed upsert: a base value stays unless it is missing or its field is to be overwritten.

    A missing update never replaces a value. Keys of either side are kept; columns are those
    of ``base``, and those that ``updates`` lacks stay as they are. One row a key expected.
    """
    kinds = dict(base.dtypes)
    new = updates.select(*[F.col(c).alias(f"_new_{c}" if c != key else c) for c in updates.columns])
    both = base.join(new, key, "full_outer")
    out = []
    for c in base.columns:
        if c == key or c not in updates.columns:
            out.append(F.col(c))
            continue
        old, fresh = F.col(c), F.col(f"_new_{c}")
        use = ~is_missing(fresh, kinds[c]) & (F.lit(c in overwrite) | is_missing(old, kinds[c]))
        out.append(F.when(use, fresh).otherwise(old).alias(c))
    return both.select(*out)


def upsert_last(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: one row for each fallback key (first non-blank of ``keys``, else the whole row)."""
    rows = base.unionByName(updates, allowMissingColumns=True)
    key = F.coalesce(*[F.when(F.trim(F.col(k).cast("string")) != "", F.col(k).cast("string")) for k in keys], F.to_json(F.struct(*[c for c in rows.columns if c != order])))
    return last_by_key(rows.withColumn("_key", key), ["_key"], F.col(order)).drop("_key")


def new_items(first: Column, second: Column, least: int = 3, share: float = 0.3) -> Column:
    """Does a second page bring enough new links? At least 3 and 30 % of the first page's."""
    fresh = F.size(F.array_except(second, first))
    return fresh >= F.greatest(F.lit(least), F.ceil(share * F.size(first)))
