"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.operators import dedupe, profile, rules
from lakemason.sources.tables import table

NUMBERS = ["price_usd", "size_m2", "bedrooms", "bathrooms", "unit_floor", "building_total_floors"]
FIELDS = ["title", "project_name", "price_usd", "size_m2", "bedrooms", "bathrooms", "unit_floor", "district", "address", "latitude"]


def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "clean_khmer24"), "source", "Missing")


def status_share(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "clean_khmer24"), "record_status", share=True)


def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return profile.coverage(table(spark, sf, "clean_khmer24"), FIELDS)


def coverage_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return profile.coverage_by(table(spark, sf, "clean_khmer24"), "record_status", ["price_usd", "size_m2", "district", "project_name"])


def number_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return profile.numeric_summary(table(spark, sf, "clean_khmer24"), NUMBERS)


def describe_lines(spark: SparkSession, sf: str) -> DataFrame:
    return profile.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


def district_object(spark: SparkSession, sf: str) -> DataFrame:
    return profile.object_summary(table(spark, sf, "clean_khmer24"), "district")


def price_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_khmer24")
    return profile.outliers(rows, "price_usd").unionByName(profile.outliers(rows, "size_m2"))


def skewness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clean_khmer24").agg(F.round(profile.sample_skewness("price_usd"), 6).alias("raw"), F.round(profile.sample_skewness("size_m2"), 6).alias("size"))


def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return profile.correlation_matrix(table(spark, sf, "clean_khmer24"), ["price_usd", "size_m2", "bedrooms"])


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return profile.spearman(table(spark, sf, "clean_khmer24"), "price_usd", "size_m2")


def status_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return profile.crosstab(table(spark, sf, "clean_khmer24"), ["property_type"], "record_status", ["accepted", "review", "rejected", "duplicate", "missing"], "missing")


def nation_mode(spark: SparkSession, sf: str) -> DataFrame:
    return profile.mode_by(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


def project_districts(spark: SparkSession, sf: str) -> DataFrame:
    """Projects that determine their district, on three rows or more."""
    return profile.determined_values(table(spark, sf, "clean_khmer24"), "project_name", "district", 3)


def region_nations(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))  # 25 rows
    return names


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.exact_duplicate_rows(table(spark, sf, "clean_khmer24").drop("bedroom_options"))


def repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.repeated_keys(table(spark, sf, "clean_khmer24"), ["listing_id"])


def review_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return rules.split_reason_counts(table(spark, sf, "clean_khmer24").where("record_status = 'review'"), "review_reason", "missing_review_reason")


def event_types(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_profile(table(spark, sf, "events"), "props")


def event_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def defaults(spark: SparkSession, sf: str) -> DataFrame:
    return profile.template_default(table(spark, sf, "clean_khmer24"), "city")


def sampled_orders(spark: SparkSession, sf: str) -> DataFrame:
    return profile.systematic_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 10)


def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.coalesce(F.lower(F.left("lang", F.lit(2))), F.lit("missing")).alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"), F.sum("n_chars").alias("chars"))


def price_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return profile.box_stats(table(spark, sf, "clean_khmer24"), "property_type", "price_usd")


def rooms_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distribution_by(table(spark, sf, "clean_khmer24"), "property_type", ["Condo", "Penthouse"], "bedrooms")


def drawn_customers(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample_rows(table(spark, sf, "customer"), 100, ["c_custkey"]).select("c_custkey", "c_mktsegment")


QUERIES = {q.__name__: q for q in (source_counts, status_share, field_coverage, coverage_by_status, number_ranges, describe_lines, district_object, price_outliers, skewness, pearson, spearman, status_by_type, nation_mode, project_districts, region_nations, duplicate_rows, repeated_ids, review_reasons, event_types, event_values, defaults, sampled_orders, language_counts, price_boxes, rooms_by_type, drawn_customers)}

_COVER = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count({c}) AS non_missing, round(100.0 * count({c}) / count(*), 1) AS pct FROM clean_khmer24" for c in FIELDS)
_RANGES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(CAST(min({c}) AS DOUBLE), 2) AS low, round(CAST(max({c}) AS DOUBLE), 2) AS high, round(avg({c}), 2) AS mean FROM clean_khmer24" for c in NUMBERS)
_STATS = [("count", "CAST(count({0}) AS DOUBLE)"), ("mean", "avg({0})"), ("std", "stddev_samp({0})"), ("min", "min({0})"), *[(f"p{round(100 * s):02d}", f"quantile_cont({{0}}, {s})") for s in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)], ("max", "max({0})")]
_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{n}' AS stat, round({e.format(c)}, 6) AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice") for n, e in _STATS)
_FENCES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(lo, 4) AS low_fence, round(hi, 4) AS high_fence, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_outliers, round(100.0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}), 2) AS pct FROM clean_khmer24, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM clean_khmer24)) GROUP BY lo, hi" for c in ("price_usd", "size_m2"))
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM clean_khmer24" for a, b in [("price_usd", "price_usd"), ("price_usd", "size_m2"), ("price_usd", "bedrooms"), ("size_m2", "size_m2"), ("size_m2", "bedrooms"), ("bedrooms", "bedrooms")])
_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
ORACLE = {
    "price_boxes": "SELECT property_type, count(*) AS n, min(price_usd) AS low, round(quantile_cont(price_usd, 0.25), 4) AS q1, round(quantile_cont(price_usd, 0.5), 4) AS median, round(quantile_cont(price_usd, 0.75), 4) AS q3, max(price_usd) AS high FROM clean_khmer24 WHERE price_usd IS NOT NULL GROUP BY 1",
    "rooms_by_type": "SELECT CAST(bedrooms AS VARCHAR) AS value, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE property_type = '{t}') / (SELECT greatest(count(*), 1) FROM clean_khmer24 WHERE bedrooms IS NOT NULL AND property_type = '{t}'), 2) AS \"{t}\"" for t in ("Condo", "Penthouse")) + " FROM clean_khmer24 WHERE bedrooms IS NOT NULL GROUP BY 1",
    "source_counts": "SELECT coalesce(source, 'Missing') AS value, count(*) AS n FROM clean_khmer24 GROUP BY 1",
    "status_share": "SELECT record_status AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM clean_khmer24 WHERE record_status IS NOT NULL GROUP BY 1",
    "field_coverage": _COVER,
    "coverage_by_status": "SELECT record_status, " + ", ".join(f"round(100 * avg(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END), 1) AS {c}_pct" for c in ("price_usd", "size_m2", "district", "project_name")) + " FROM clean_khmer24 GROUP BY 1",
    "number_ranges": _RANGES,
    "describe_lines": _DESCRIBE,
    "district_object": "SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique, arg_min(district, (-n, district)) AS top, max(n) AS freq FROM (SELECT district, count(*) AS n FROM clean_khmer24 WHERE district IS NOT NULL GROUP BY 1)",
    "price_outliers": _FENCES,
    "skewness": "SELECT round(skewness(price_usd), 6) AS raw, round(skewness(size_m2), 6) AS size FROM clean_khmer24",
    "pearson": _PAIRS,
    "spearman": f"SELECT 'price_usd' AS a, 'size_m2' AS b, round(corr(ra, rb), 6) AS rho FROM (SELECT {_AVG_RANK.format('price_usd')} AS ra, {_AVG_RANK.format('size_m2')} AS rb FROM clean_khmer24 WHERE price_usd IS NOT NULL AND size_m2 IS NOT NULL)",
    "status_by_type": "SELECT property_type, " + ", ".join(f"count(*) FILTER (WHERE coalesce(record_status, 'missing') = '{s}') AS {s}" for s in ("accepted", "review", "rejected", "duplicate", "missing")) + " FROM clean_khmer24 GROUP BY 1",
    "nation_mode": "SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS mode_value, max(n) AS mode_n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1",
    "project_districts": "SELECT project_name, min(district) AS district FROM clean_khmer24 WHERE project_name IS NOT NULL AND district IS NOT NULL GROUP BY 1 HAVING count(DISTINCT district) = 1 AND count(*) >= 3",
    "region_nations": "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "duplicate_rows": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM (SELECT md5(CAST(t AS VARCHAR)) AS h FROM (SELECT * EXCLUDE (bedroom_options) FROM clean_khmer24) t) GROUP BY h) t",
    "repeated_ids": "SELECT listing_id, count(*) AS n_rows, count(*) - 1 AS n_extra FROM clean_khmer24 WHERE listing_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "review_reasons": "SELECT reason, count(*) AS n FROM (SELECT trim(unnest(string_split(coalesce(review_reason, 'missing_review_reason'), ';'))) AS reason FROM clean_khmer24 WHERE record_status = 'review') WHERE reason <> '' GROUP BY 1",
    "event_types": "SELECT key, CASE json_type(props, concat('$.', key)) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS kind, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2",
    "event_values": "SELECT event_type, count(*) AS n, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "defaults": "SELECT arg_min(city, (-n, city)) AS top_value, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM (SELECT city, count(*) AS n FROM clean_khmer24 WHERE city IS NOT NULL GROUP BY 1) HAVING sum(n) >= 20 AND max(n) > 0.5 * sum(n)",
    "sampled_orders": "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p % 10 = 0",
    "language_counts": "SELECT coalesce(lower(left(lang, 2)), 'missing') AS lang, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(text, ' '), '') = '') AS blank, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
}
