"""Human decisions as tables: queues to decide on, checks of what came back, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemason.functions.text import excerpt


def review_queue(df: DataFrame, evidence: list[str], corrections: list[str], order: list[Column], text: str | None = None) -> DataFrame:
    """Rows to decide on: empty decision and correction columns, then evidence, in a stable order."""
    empty = F.lit(None).cast("string")
    shown = [excerpt(F.col(c)).alias(c) if c == text else F.col(c) for c in evidence]
    return df.orderBy(*order).select(empty.alias("manual_decision"), empty.alias("manual_note"), *[empty.alias(f"corrected_{c}") for c in corrections], *shown)


def decision_problems(decisions: DataFrame, key: str, decision: str, note: str, allowed: list[str]) -> DataFrame:
    """(key, problem) of decisions outside the allowed ones, without a note, or repeated."""
    value = F.lower(F.trim(decision))
    known = F.coalesce(value.isin(*allowed), F.lit(False))
    blank = F.coalesce(F.trim(note), F.lit("")) == ""
    one = decisions.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(known).alias("known"), F.bool_or(blank).alias("blank"))
    problems = F.array_compact(F.array(F.when(~F.col("known"), "unknown_decision"), F.when(F.col("blank"), "missing_note"), F.when(F.col("n") > 1, "repeated")))
    return one.select(key, F.explode(problems).alias("problem"))


def apply_corrections(df: DataFrame, decisions: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Non-blank, well-typed corrections replace values; each leaves '<field>: old -> new' in ``notes``.

    Corrections that can't be read as the field's type are ignored. ``<field>_source`` of a
    corrected field becomes manual_review where there is such a column.
    """
    side = decisions.select(F.col(key), *[F.when(F.trim(f"corrected_{f}") != "", F.trim(f"corrected_{f}")).try_cast(t).alias(f"_c_{f}") for f, t in fields.items()])
    out = df.join(side, key, "left")
    notes = [F.when(F.col(f"_c_{f}").isNotNull(), F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("null")), F.lit(" -> "), F.col(f"_c_{f}").cast("string"))) for f in fields]
    out = out.withColumn("notes", F.array_join(F.array_compact(F.array(*notes)), "; "))
    changed = {f"{f}_source": F.when(F.col(f"_c_{f}").isNotNull(), "manual_review").otherwise(F.col(f"{f}_source")) for f in fields if f"{f}_source" in df.columns}
    return out.withColumns(changed | {f: F.coalesce(F.col(f"_c_{f}"), F.col(f)) for f in fields}).drop(*[f"_c_{f}" for f in fields])


def pair_actions(decisions: DataFrame) -> DataFrame:
    """(remove_id, keep_id) from pairs judged duplicate with a keep_listing_id; pairs that keep neither are left out."""
    keep = F.col("keep_listing_id")
    dup = decisions.where(F.lower(F.trim("manual_decision")) == "duplicate")
    return dup.select(F.when(keep == F.col("a"), F.col("b")).when(keep == F.col("b"), F.col("a")).alias("remove_id"), keep.alias("keep_id")).where("remove_id is not null").distinct()


def conflicting_actions(actions: DataFrame) -> DataFrame:
    """Ids to be removed in favour of different ones."""
    return actions.groupBy("remove_id").agg(F.count_distinct("keep_id").alias("n_keep")).where("n_keep > 1")
