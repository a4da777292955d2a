"""Points near other points or in regions, by triangulated regions in bounding-volume hierarchies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemason.functions.polygons import TriangleTree, disc, ear_clip, haversine_m

#: Triangles that one task holds at a time (about 10 MB). A larger set of regions is cut by
#: grid cell, and each cell's triangles meet only the points of that cell.
BLOCK_TRIANGLES = 100_000
#: Points of one cell that meet in one task; a cell with more is split into so many salts.
CELL_POINTS = 200_000
TRIANGLES = "region string, ax double, ay double, bx double, by double, cx double, cy double"


def position(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(latitude, longitude) at their right place, nulls where there is no usable position.

    A latitude beyond 90 degrees with a longitude within them was stored the wrong way
    round. Missing, not finite or impossible values and the origin (0, 0) are not usable.
    """
    swapped = (F.abs(lat) > 90) & (F.abs(lon) <= 90)
    y, x = F.when(swapped, lon).otherwise(lat), F.when(swapped, lat).otherwise(lon)
    usable = (F.abs(y) <= 90) & (F.abs(x) <= 180) & ~F.isnan(y) & ~F.isnan(x) & ~((y == 0) & (x == 0))
    return F.when(usable, y), F.when(usable, x)


def triangulate(regions: DataFrame) -> DataFrame:
    """(region, three corners) from (region string, ring array<struct<x, y>>)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, ring in zip(batch["region"], batch["ring"], strict=True):
                if ring is not None:
                    rows += [(name, *a, *b, *c) for a, b, c in ear_clip([(p["x"], p["y"]) for p in ring])]
            yield pd.DataFrame(rows, columns=["region", "ax", "ay", "bx", "by", "cx", "cy"])

    return regions.select(F.col("region").cast("string"), "ring").mapInPandas(cut, TRIANGLES)


def disc_regions(places: DataFrame, name: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """A containing polygon for the disc around each place with a usable position."""
    y, x = position(F.col(lat), F.col(lon))

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def around(ys: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([[{"x": a, "y": b} for a, b in disc(v, u, radius_m)] for v, u in zip(ys, xs, strict=True)])

    usable = places.select(F.col(name).cast("string").alias("region"), y.alias("y"), x.alias("x")).dropna()
    return usable.select("region", around("y", "x").alias("ring"))


def _tree(frame: pd.DataFrame) -> TriangleTree:
    corners = frame[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(float).reshape(-1, 3, 2)
    return TriangleTree(corners)


def _meet(batch: pd.DataFrame, tree: TriangleTree, names: np.ndarray) -> pd.DataFrame:
    x, y = batch["x"].to_numpy(float), batch["y"].to_numpy(float)
    at, triangle = tree.locate(x, y)
    # a point on a shared edge lies in several triangles of one region: once is enough
    out = pd.DataFrame({"id": batch["id"].to_numpy()[at], "x": x[at], "y": y[at], "region": names[triangle]})
    return out.drop_duplicates(["id", "region"])


def points_in_regions(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Distinct (id, x, y, region) of every point (id, x, y) in or on a region's boundary.

    Points without coordinates have no row; a point in several regions has one for each.
    Up to ``BLOCK_TRIANGLES`` (counted first) every task holds one hierarchy over all
    triangles, and points stream past without a shuffle. Beyond it, triangles go to the grid
    cells that their boxes touch, points to their cell; cells with many points are salted,
    with the cell's triangles repeated for each salt.
    """
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    kind = dict(points.dtypes)["id"]
    schema = f"id {kind}, x double, y double, region string"
    few = triangles.limit(BLOCK_TRIANGLES + 1).toPandas()
    if len(few) <= BLOCK_TRIANGLES:
        held = points.sparkSession.sparkContext.broadcast(few)

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, names = _tree(held.value), held.value["region"].to_numpy()
            for batch in batches:
                yield _meet(batch, tree, names)

        return points.mapInPandas(stream, schema)
    return _by_cell(points, triangles, schema)


def _by_cell(points: DataFrame, triangles: DataFrame, schema: str) -> DataFrame:
    lo_x, hi_x = F.least("ax", "bx", "cx"), F.greatest("ax", "bx", "cx")
    lo_y, hi_y = F.least("ay", "by", "cy"), F.greatest("ay", "by", "cy")
    stats = triangles.agg(F.max(hi_x - lo_x), F.max(hi_y - lo_y), F.avg(F.greatest(hi_x - lo_x, hi_y - lo_y))).first()
    side = max(stats[2] * 8, max(stats[0], stats[1]) / 64, 1e-9)  # a triangle touches 65 x 65 cells at most
    cell = lambda v: F.floor(v / side)
    spots = points.select("id", "x", "y", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    salts = spots.groupBy("gx", "gy").agg(F.ceil(F.count("*") / CELL_POINTS).cast("int").alias("salts"))
    spread = triangles.select("*", F.explode(F.sequence(cell(lo_x), cell(hi_x))).alias("gx"), F.sequence(cell(lo_y), cell(hi_y)).alias("ys")).select("*", F.explode("ys").alias("gy")).drop("ys")
    spread = spread.join(salts, ["gx", "gy"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    spots = spots.join(salts, ["gx", "gy"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"][:0], "x": [], "y": [], "region": []})
        return _meet(left, _tree(right), right["region"].to_numpy())

    keys = ["gx", "gy", "salt"]
    return spots.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(meet, schema)


def places_within(points: DataFrame, id_col: str, lat: str, lon: str, places: DataFrame, name: str, place_lat: str, place_lon: str, radius_m: float) -> DataFrame:
    """Distinct (id, place, metres) of every place at most ``radius_m`` from a point.

    Points or places without a usable position have no case; both are read at their right
    place where latitude and longitude were exchanged. Two places of one name count as one,
    at the smaller distance; null names and null ids give no row. The triangulated discs
    contain the true ones; the great circle decides exactly.
    """
    y, x = position(F.col(lat), F.col(lon))
    py, px = position(F.col(place_lat), F.col(place_lon))
    sites = places.select(F.col(name).cast("string").alias("place"), py.alias("py"), px.alias("px")).dropna().distinct()
    tagged = sites.withColumn("spot", F.concat_ws("\u0001", "place", "py", "px"))
    triangles = triangulate(disc_regions(tagged, "spot", "py", "px", radius_m))
    spots = points.select(F.col(id_col).alias("id"), x.alias("x"), y.alias("y")).where(F.col("id").isNotNull())
    part = F.split("region", "\u0001")
    met = points_in_regions(spots, triangles).select("id", "x", "y", part[0].alias("place"), part[1].cast("double").alias("py"), part[2].cast("double").alias("px"))

    @F.pandas_udf("double")
    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(haversine_m(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float), d.to_numpy(float)))

    near = met.withColumn("metres", metres("y", "x", "py", "px")).where(F.col("metres") <= radius_m)
    return near.groupBy("id", "place").agg(F.min("metres").alias("metres"))
