"""Queries of the general training-data problems: points near places, and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.operators.fill import fill_in_time, majority, unanimous
from lakemason.operators.geo import places_within
from lakemason.operators.lookup import resolve_values
from lakemason.sources.tables import cut_lineage, table

NEAR_M = 750.0
#: Seconds over which a building's district, and the name of the project at an address, may be
#: carried: buildings keep theirs for decades, renaming is rare.
DISTRICT_GAP = NAME_GAP = 10 * 365.25 * 86_400
#: Order in which coordinates were delivered: the table has no time, so fills get no distance.
DELIVERIES = 1000.0


def name_key(name: Column) -> Column:
    """Lower case, single blanks; null for a blank name."""
    key = F.lower(F.trim(F.regexp_replace(F.translate(name, "\u00a0\u202f\u3000", "   "), r"\s+", " ")))
    return F.when(key != "", key)


def p3_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coord_id, landmark_name, metres) of every landmark within 750 m of a record."""
    near = places_within(table(spark, sf_dir, "validated_project_coordinates"), "coord_id", "latitude", "longitude", table(spark, sf_dir, "landmarks"), "name", "lat", "lon", NEAR_M)
    return near.select(F.col("id").alias("coord_id"), F.col("place").alias("landmark_name"), F.round("metres", 2).alias("metres"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_distances(spark, sf_dir).select("coord_id", "landmark_name")


def _adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an advert: rows that repeat a listing_id hold the same values."""
    rows = table(spark, sf_dir, "clean_khmer24").where(F.col("listing_id").isNotNull())
    seconds = F.unix_timestamp(F.try_to_timestamp("scraped_at"))
    one = rows.groupBy("listing_id").agg(F.max("project_name").alias("project_name"), F.max("district").alias("district"), F.max("address").alias("address"), F.max(seconds).alias("t"))
    return one.select("listing_id", "district", "project_name", name_key(F.col("project_name")).alias("project"), name_key(F.col("address")).alias("place"), F.col("t").cast("double").alias("t"))


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "validated_project_coordinates")
    return rows.select("coord_id", "district", "latitude", "longitude", name_key(F.col("project_name")).alias("project"))


def _marked(filled: DataFrame, table_name: str, record: str, field: str, value: Column) -> DataFrame:
    method, distance = F.col(f"{field}_method"), F.col(f"{field}_distance")
    return filled.where(method.isin("carried", "interpolated", "undated")).select(F.lit(table_name).alias("table_name"), F.col(record).cast("string").alias("record_id"), F.lit(field).alias("field_name"), value.alias("filled_value"), method.alias("method"), distance.alias("distance"))


def _coordinate_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude and longitude of records whose project's complete records all agree, in the order of delivery."""
    rows = _coordinates(spark, sf_dir).where(F.col("project").isNotNull())
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    rows = rows.withColumn("lat6", micro("latitude")).withColumn("lon6", micro("longitude"))
    both = F.when(F.col("lat6").isNotNull() & F.col("lon6").isNotNull(), F.struct("lat6", "lon6"))
    open_ = rows.join(unanimous(rows, "project", both), "project")
    complete = both.isNotNull()
    named = cut_lineage(open_.select("coord_id", "project", "agreed", F.col("lat6").cast("double").alias("latitude"), F.col("lon6").cast("double").alias("longitude"), complete.alias("complete")))
    filled = fill_in_time(named, "project", F.col("coord_id"), {"latitude": "number", "longitude": "number"}, {f: F.col("complete") for f in ("latitude", "longitude")}, slice_width=DELIVERIES, undated=True)
    out = None
    for field, at in (("latitude", "lat6"), ("longitude", "lon6")):
        value = F.round(f"{field}_filled").cast("long")
        part = _marked(filled.where(value == F.col(f"agreed.{at}")), "validated_project_coordinates", "coord_id", field, value.cast("string")).withColumn("distance", F.lit(None).cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def _name_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project names that more than half of the named adverts of one address agree on."""
    rows = _adverts(spark, sf_dir).where(F.col("place").isNotNull())
    rows = rows.select("listing_id", "place", "t", F.col("project").alias("project_name"))
    open_ = cut_lineage(rows.join(majority(rows, "place", F.col("project_name")), "place"))
    filled = fill_in_time(open_, "place", F.col("t"), {"project_name": "category"}, {"project_name": F.col("project_name") == F.col("agreed")}, {"project_name": NAME_GAP}, undated=True)
    return _marked(filled.where(F.col("project_name_filled") == F.col("agreed")), "clean_khmer24", "listing_id", "project_name", F.col("project_name_filled"))


def _district_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of adverts whose project's records, in both tables, all stand for the same one.

    Adverts share one clock; coordinates have none, and supply what no advert supplies.
    """
    adverts = _adverts(spark, sf_dir).select(F.col("listing_id").alias("record_id"), "project", "t", "district", F.lit("clean_khmer24").alias("table_name"))
    records = _coordinates(spark, sf_dir).select(F.col("coord_id").cast("string").alias("record_id"), "project", F.lit(None).cast("double").alias("t"), "district", F.lit("validated_project_coordinates").alias("table_name"))
    rows = adverts.unionByName(records).where(F.col("project").isNotNull())
    names = resolve_values(table(spark, sf_dir, "clean_khmer24").select("district").unionByName(table(spark, sf_dir, "validated_project_coordinates").select("district")), "district", table(spark, sf_dir, "district_mapping"), "raw_name", "standard_name")
    known = rows.join(names.select(F.col("value").alias("district"), F.col("standard").alias("meant")), "district", "left")
    known = cut_lineage(known.select("record_id", "table_name", "project", "t", F.col("district").isNull().alias("blank"), F.col("meant").alias("district")))
    open_ = cut_lineage(known.join(unanimous(known, "project", F.col("district")), "project"))
    filled = fill_in_time(open_, "project", F.col("t"), {"district": "category"}, gap={"district": DISTRICT_GAP}, undated=True)
    wanted = filled.where(F.col("blank") & (F.col("table_name") == "clean_khmer24") & (F.col("district_filled") == F.col("agreed")))
    return _marked(wanted, "clean_khmer24", "record_id", "district", F.col("district_filled"))


def p7_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filled values, each with the method and the distance in seconds to the record it came from, where both have a time."""
    return _district_fills(spark, sf_dir).unionByName(_name_fills(spark, sf_dir)).unionByName(_coordinate_fills(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_marked(spark, sf_dir).select("table_name", "record_id", "field_name", "filled_value")


def p7_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled coordinates alone."""
    return _coordinate_fills(spark, sf_dir).select("table_name", "record_id", "field_name", "filled_value")


def p7_project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled project names alone."""
    return _name_fills(spark, sf_dir).select("table_name", "record_id", "field_name", "filled_value")


QUERIES = {"p3_found": p3_found, "p3_distances": p3_distances, "p7_found": p7_found, "p7_marked": p7_marked, "p7_coordinates": p7_coordinates, "p7_project_names": p7_project_names}

_NEAR = """
WITH pts AS (
  SELECT coord_id, CASE WHEN abs(latitude) > 90 AND abs(longitude) <= 90 THEN longitude ELSE latitude END AS la,
         CASE WHEN abs(latitude) > 90 AND abs(longitude) <= 90 THEN latitude ELSE longitude END AS lo
  FROM validated_project_coordinates WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
lm AS (
  SELECT name, CASE WHEN abs(lat) > 90 AND abs(lon) <= 90 THEN lon ELSE lat END AS la,
         CASE WHEN abs(lat) > 90 AND abs(lon) <= 90 THEN lat ELSE lon END AS lo
  FROM landmarks WHERE lat IS NOT NULL AND lon IS NOT NULL),
d AS (
  SELECT coord_id, name AS landmark_name,
         2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lm.la - pts.la) / 2), 2)
           + cos(radians(pts.la)) * cos(radians(lm.la)) * pow(sin(radians(lm.lo - pts.lo) / 2), 2)))) AS metres
  FROM pts JOIN lm ON abs(lm.la - pts.la) < 0.02 WHERE abs(pts.la) <= 90 AND NOT (pts.la = 0 AND pts.lo = 0))
"""
_KEY = "nullif(lower(trim(regexp_replace({0}, '[\\s\\x{{00A0}}\\x{{3000}}]+', ' ', 'g'))), '')"
_FILL = f"""
WITH v AS (SELECT *, {_KEY.format("project_name")} AS k FROM validated_project_coordinates),
u AS (SELECT k, min(round(latitude * 1e6)) AS la, min(round(longitude * 1e6)) AS lo FROM v WHERE k IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
  GROUP BY k HAVING count(DISTINCT (round(latitude * 1e6), round(longitude * 1e6))) = 1)
SELECT 'validated_project_coordinates' AS table_name, CAST(coord_id AS VARCHAR) AS record_id, 'latitude' AS field_name, CAST(CAST(la AS BIGINT) AS VARCHAR) AS filled_value FROM v JOIN u USING (k) WHERE latitude IS NULL
UNION ALL SELECT 'validated_project_coordinates', CAST(coord_id AS VARCHAR), 'longitude', CAST(CAST(lo AS BIGINT) AS VARCHAR) FROM v JOIN u USING (k) WHERE longitude IS NULL
"""
_NAMES = f"""
WITH k AS (SELECT listing_id, max({_KEY.format("project_name")}) AS p, max({_KEY.format("address")}) AS a FROM clean_khmer24 WHERE listing_id IS NOT NULL GROUP BY 1),
n AS (SELECT a, p, count(*) AS n FROM k WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2),
m AS (SELECT a, p FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS t FROM n) WHERE 2 * n > t)
SELECT 'clean_khmer24' AS table_name, listing_id AS record_id, 'project_name' AS field_name, m.p AS filled_value FROM k JOIN m ON m.a = k.a WHERE k.p IS NULL
"""
ORACLE = {
    "p7_coordinates": _FILL,
    "p7_project_names": _NAMES,
    "p3_found": _NEAR + "SELECT coord_id, landmark_name FROM d WHERE metres <= 750",
    "p3_distances": _NEAR + "SELECT coord_id, landmark_name, round(metres, 2) AS metres FROM d WHERE metres <= 750",
}
