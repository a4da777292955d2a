"""Grouped analytics as a dashboard asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemason.functions.numeric import cut, ratio
from lakemason.operators.profile import cap_at_quantile, histogram
from lakemason.sources.tables import table

LEAST_GROUP = 20


def filtered(df: DataFrame, equal: dict | None = None, within: dict | None = None, between: dict | None = None) -> DataFrame:
    """Optional filters: an empty or null choice filters nothing; ranges hold both ends."""
    for c, v in (equal or {}).items():
        df = df if v in (None, "", "All") else df.where(F.col(c) == v)
    for c, v in (within or {}).items():
        df = df if not v else df.where(F.col(c).isin(*v))
    for c, v in (between or {}).items():
        df = df if not v else df.where(F.col(c).between(*v))
    return df


def group_summary(df: DataFrame, group: str, price: Column, unit_price: Column, least: int = LEAST_GROUP) -> DataFrame:
    """(group, listings, median_price, median_unit_price) of groups with ``least`` rows or more; exact medians."""
    one = df.select(group, price.alias("p"), unit_price.alias("u")).groupBy(group)
    return one.agg(F.count("*").alias("listings"), F.round(F.median("p"), 3).alias("median_price"), F.round(F.median("u"), 3).alias("median_unit_price")).where(F.col("listings") >= least)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    return lines.join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


def market_summary(spark: SparkSession, sf: str) -> DataFrame:
    return group_summary(_lines(spark, sf), "p_brand", F.col("l_extendedprice"), ratio(F.col("l_extendedprice"), F.col("l_quantity")))


def market_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = filtered(_lines(spark, sf), {"l_returnflag": "R"}, {"p_brand": []}, {"l_quantity": (10, 30)})
    return group_summary(rows, "p_brand", F.col("l_extendedprice"), ratio(F.col("l_extendedprice"), F.col("l_quantity")))


def market_overview(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_khmer24")
    return rows.agg(F.count("*").alias("listings"), F.count_distinct("district").alias("districts"), F.count_distinct("project_name").alias("projects"), F.count("price_usd").alias("priced"), F.round(F.avg("price_usd"), 2).alias("mean_price"))


def district_market(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_khmer24").where(F.col("district").isNotNull())
    return group_summary(rows, "district", F.col("price_usd"), ratio(F.col("price_usd"), F.col("size_m2")))


def type_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows against non-null values: the two counts differ where a field is missing."""
    rows = table(spark, sf, "clean_khmer24")
    return rows.groupBy("property_type").agg(F.count("*").alias("listings"), F.count("price_usd").alias("priced"), F.count("size_m2").alias("sized"), F.round(F.median("price_usd"), 2).alias("median_price"))


def price_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_khmer24").where(F.col("price_usd").isNotNull())
    band = cut(F.col("price_usd"), [0, 50_000, 100_000, 200_000, 400_000, 1e9], ["to_50k", "to_100k", "to_200k", "to_400k", "more"])
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def price_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(table(spark, sf, "lineitem"), "l_extendedprice", 40, 0.0, 120_000.0)


def capped_prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = cap_at_quantile(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", 0.99)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("highest"))


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_custkey", "o_totalprice")


def segment_share(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"))
    return one.select("c_mktsegment", F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy()), 4).alias("pct"))  # one row a segment


def monthly_revenue(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where(F.col("l_discount").between(0.02, 0.08))
    return lines.groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {q.__name__: q for q in (market_summary, market_filtered, market_overview, district_market, type_summary, price_bands, price_histogram, capped_prices, top_orders, segment_share, monthly_revenue)}
_GROUP = "count(*) AS listings, round(median(p), 3) AS median_price, round(median(u), 3) AS median_unit_price"
_LINES = "SELECT p_brand, l_extendedprice AS p, CASE WHEN l_extendedprice > 0 AND l_quantity > 0 THEN round(l_extendedprice / l_quantity, 2) END AS u FROM lineitem JOIN part ON l_partkey = p_partkey"
ORACLE = {
    "market_summary": f"SELECT p_brand, {_GROUP} FROM ({_LINES}) GROUP BY p_brand HAVING count(*) >= 20",
    "market_filtered": f"SELECT p_brand, {_GROUP} FROM ({_LINES} WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 30) GROUP BY p_brand HAVING count(*) >= 20",
    "market_overview": "SELECT count(*) AS listings, count(DISTINCT district) AS districts, count(DISTINCT project_name) AS projects, count(price_usd) AS priced, round(avg(price_usd), 2) AS mean_price FROM clean_khmer24",
    "district_market": f"SELECT district, {_GROUP} FROM (SELECT district, price_usd AS p, CASE WHEN price_usd > 0 AND size_m2 > 0 THEN round(price_usd / size_m2, 2) END AS u FROM clean_khmer24 WHERE district IS NOT NULL) GROUP BY district HAVING count(*) >= 20",
    "type_summary": "SELECT property_type, count(*) AS listings, count(price_usd) AS priced, count(size_m2) AS sized, round(median(price_usd), 2) AS median_price FROM clean_khmer24 GROUP BY property_type",
    "price_bands": "SELECT CASE WHEN price_usd >= 0 AND price_usd <= 50000 THEN 'to_50k' WHEN price_usd > 50000 AND price_usd <= 100000 THEN 'to_100k' WHEN price_usd > 100000 AND price_usd <= 200000 THEN 'to_200k' WHEN price_usd > 200000 AND price_usd <= 400000 THEN 'to_400k' WHEN price_usd > 400000 AND price_usd <= 1e9 THEN 'more' END AS band, count(*) AS n FROM clean_khmer24 WHERE price_usd IS NOT NULL GROUP BY 1",
    "price_histogram": "SELECT CAST(least(floor(l_extendedprice / 3000.0), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 120000 GROUP BY 1",
    "capped_prices": "SELECT l_returnflag, count(*) AS n, round(max(l_extendedprice), 2) AS highest FROM lineitem WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem) GROUP BY 1",
    "top_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "segment_share": "SELECT c_mktsegment, round(100 * sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 4) AS pct FROM customer GROUP BY 1",
    "monthly_revenue": "SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY 1, 2",
}
