"""An ordered rule engine: conditions give reasons, reasons give a status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: 'reject' or 'review'. The condition counts as false where it is null."""

    name: str
    kind: str
    condition: Column


def classify(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds reject_reasons and review_reasons (arrays, in the rules' order) and record_status.

    Any reject reason rejects, and review reasons are kept beside it; else any review reason
    puts a row up for review; needs_review is true for those only.
    """
    def reasons(kind: str) -> Column:
        own = [F.when(r.condition, F.lit(r.name)) for r in rules if r.kind == kind]
        return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")

    out = df.withColumns({"reject_reasons": reasons("reject"), "review_reasons": reasons("review")})
    status = F.when(F.size("reject_reasons") > 0, "rejected").when(F.size("review_reasons") > 0, "review").otherwise("accepted")
    return out.withColumn("record_status", status).withColumn("needs_review", F.col("record_status") == "review")


def mark_duplicates(df: DataFrame, duplicate: Column) -> DataFrame:
    """Duplicates get a status of their own and lose their reasons."""
    empty = F.array().cast("array<string>")
    return df.withColumns({
        "record_status": F.when(duplicate, "duplicate").otherwise(F.col("record_status")), "needs_review": ~duplicate & F.col("needs_review"),
        "reject_reasons": F.when(duplicate, empty).otherwise(F.col("reject_reasons")), "review_reasons": F.when(duplicate, empty).otherwise(F.col("review_reasons")),
    })


def reason_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(reason, n) over arrays of reasons."""
    return df.select(F.explode(F.concat(*columns)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def split_reason_counts(df: DataFrame, column: str, missing: str) -> DataFrame:
    """(reason, n) over '; '-joined reasons, blanks left out, null counted as ``missing``."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit(missing)), ";"), lambda r: F.trim(r)), lambda r: r != "")
    return df.select(F.explode(parts).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reconcile(parts: dict[str, int], total: int) -> None:
    """Raise where the parts of a split don't add up to the whole."""
    if sum(parts.values()) != total:
        raise ValueError(f"parts {parts} add up to {sum(parts.values())}, not {total}")
