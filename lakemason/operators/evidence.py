"""Triage, audits and row-level checks: cohorts, evidence counts, validation that marks instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemason.operators.profile import determined_values


def cohorts(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(cohort, n) of any number of conditions in one pass; null counts as false."""
    one = df.agg(F.array(*[F.struct(F.lit(n).alias("cohort"), F.count_if(F.coalesce(c, F.lit(False))).alias("n")) for n, c in named.items()]).alias("all"))
    return one.select(F.explode("all").alias("s")).select("s.*")


def triage(df: DataFrame, key: str, target: str) -> DataFrame:
    """Rows without ``target``: resolvable (their key has one), ambiguous (several) or unmapped (none), with counts."""
    known = df.where(F.col(target).isNotNull() & F.col(key).isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))
    single = determined_values(df, key, target).select(F.col(key), F.col(target).alias("_one"))
    rows = df.where(F.col(target).isNull()).select(key).join(known, key, "left").join(single, key, "left")
    verdict = F.when(F.col("_one").isNotNull(), "resolvable").when(F.col("_known"), "ambiguous").otherwise("unmapped")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def evidence_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n) over arrays of struct(column, found)."""
    return df.select(F.explode(column).alias("e")).groupBy(F.col("e.column").alias("column")).agg(F.count("*").alias("n"))


def validated(df: DataFrame, errors: list[tuple[str, Column]], warnings: list[tuple[str, Column]] = ()) -> DataFrame:
    """Adds status ('ok' or 'error'), error (the first that holds) and warnings (all that hold)."""
    first = F.coalesce(*[F.when(c, F.lit(n)) for n, c in errors], F.lit(None).cast("string"))
    every = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in warnings])) if warnings else F.array().cast("array<string>")
    return df.withColumns({"error": first, "warnings": every}).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def scored_estimates(df: DataFrame, actual: str, estimate: str, lower: str, upper: str) -> DataFrame:
    """absolute_error, percentage_error and inside_range of estimates against known values; nulls where one is missing."""
    off = F.abs(F.col(estimate) - F.col(actual))
    return df.withColumns({"absolute_error": off, "percentage_error": F.when(F.col(actual) != 0, 100 * off / F.abs(actual)), "inside_range": F.col(actual).between(F.col(lower), F.col(upper))})


def require(violations: DataFrame, what: str) -> None:
    """Raise where a table of violations has rows, showing a few."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def violations(df: DataFrame, key: str, required: list[str], positive: list[str] = (), domains: dict[str, list] | None = None) -> DataFrame:
    """(key, problem) of repeated keys, missing required fields, numbers not above 0 and values outside their domain."""
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing_{c}")) for c in required]
    low = [F.when(F.col(c) <= 0, F.lit(f"not_positive_{c}")) for c in positive]
    out = [F.when(~F.col(c).isin(*v), F.lit(f"unknown_{c}")) for c, v in (domains or {}).items()]
    single = df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*blank, *low, *out))).alias("problem"))
    again = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated").alias("problem"))
    return single.unionByName(again)
