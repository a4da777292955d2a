"""Recovering missing places stage by stage, and judging coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemason.functions.numeric import in_box
from lakemason.operators.dedupe import repeated
from lakemason.operators.profile import determined_values


def waterfall(df: DataFrame, target: str, stages: list[tuple[str, object]]) -> DataFrame:
    """Fill ``target`` stage by stage where it is still null; ``<target>_source`` names the stage.

    A stage is (name, Column) or (name, function of the table so far -> Column or DataFrame
    with a column ``_fill``): later stages may learn from what earlier ones filled.
    """
    source = f"{target}_source"
    out = df.withColumn(source, F.when(F.col(target).isNotNull(), "original"))
    for name, stage in stages:
        got = stage(out) if callable(stage) else stage
        filled = got if isinstance(got, DataFrame) else out.withColumn("_fill", got)
        new = F.col(target).isNull() & F.col("_fill").isNotNull()
        out = filled.withColumn(source, F.when(new, name).otherwise(F.col(source))).withColumn(target, F.coalesce(target, "_fill")).drop("_fill")
    return out


def learned_fill(key: str, target: str, least: int = 3):
    """A stage that fills from keys that determine the target in the rows known so far."""

    def stage(df: DataFrame) -> DataFrame:
        known = determined_values(df, key, target, least).select(F.col(key), F.col(target).alias("_fill"))
        return df.join(known, key, "left")

    return stage


def overrides(df: DataFrame, key: str, target: str, table: DataFrame) -> DataFrame:
    """Values set by hand, by key; they win over everything."""
    side = table.select(F.col(key), F.col(target).alias("_set"))
    return df.join(side, key, "left").withColumn(target, F.coalesce("_set", target)).drop("_set")


def geocode_level(levels: list[tuple[str, Column]]) -> Column:
    """The first level whose evidence is there; 'insufficient' without any."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in levels], F.lit("insufficient"))


def check_coordinates(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Adds coordinate_check: missing, invalid_outside, review_duplicate_coordinate or valid."""
    south, north, west, east = box
    check = F.when(~in_box(F.col(lat), F.col(lon), south, north, west, east), "invalid_outside").when(F.col("_again"), "review_duplicate_coordinate").otherwise("valid")
    check = F.when(F.col(lat).isNull() | F.col(lon).isNull(), "missing").otherwise(check)
    return repeated(df, [lat, lon], "_again").withColumn("coordinate_check", check).drop("_again")


def evidence(columns: dict[str, Column]) -> Column:
    """array<struct(column, found)> of columns in which something was found."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("column"), c.alias("found"))) for n, c in columns.items()]))


def consistent(ev: Column) -> Column:
    """Do all pieces of evidence say the same?"""
    return F.size(F.array_distinct(F.transform(ev, lambda e: e["found"]))) == 1
