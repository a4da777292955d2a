"""The model workflow on line items: price per line from quantity, part and flags."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.operators import modelling as M
from lakemason.operators.profile import regression_metrics
from lakemason.sources.tables import shared_folder, table
from lakemason.streaming.upsert import latest, upsert_stream

NUMBERS, WORDS = ["l_quantity", "p_size"], ["p_brand", "l_returnflag"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_retailprice")
    return lines.join(parts, "l_partkey").withColumn("label", F.log1p("l_extendedprice"))


def _formula(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", (F.col("l_quantity") * 1500.0).alias("predicted"))


def formula_metrics(spark: SparkSession, sf: str) -> DataFrame:
    one = regression_metrics(_formula(spark, sf), "l_extendedprice", "predicted")
    return one.select(*[F.round(c, 4).alias(c) for c in ("rmse", "mae", "mape", "r2")])


def conformal_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = _formula(spark, sf).withColumn("residual", F.log1p("l_extendedprice") - F.log1p("predicted"))
    return spark.createDataFrame([(M.conformal_width(rows, "residual"),)], "width double").select(F.round("width", 8).alias("width"))


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    label = M.split_label(F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return table(spark, sf, "lineitem").groupBy(label.alias("part"), "l_returnflag").agg(F.count("*").alias("n"))


def _fitted(spark: SparkSession, sf: str):
    held = _rows(spark, sf).withColumn("part", M.split_label(F.concat_ws("-", "l_orderkey", "l_linenumber"))).persist()  # read by medians, fit and scores
    rows, _ = M.impute(held, NUMBERS, WORDS)
    model = M.pipeline(NUMBERS, WORDS, "label", "linear", regParam=0.0).fit(rows.where("part = 'train'"))
    return rows, model, model.transform(rows)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows with estimate and calibrated interval."""
    _, _, scored = _fitted(spark, sf)
    width = M.conformal_width(scored.where("part = 'calibration'").select((F.col("label") - F.col("prediction")).alias("r")), "r")
    out = M.with_interval(scored.where("part = 'test'"), "prediction", width)
    inside = F.col("l_extendedprice").between(F.col("lower"), F.col("upper"))
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(inside.cast("int")), 4).alias("covered"), F.round(F.avg(F.abs(F.col("estimate") / F.col("l_extendedprice") - 1)), 4).alias("error"))


def factor_importance(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.stat import Summarizer

    rows, model, scored = _fitted(spark, sf)
    means = [float(v) for v in scored.where("part = 'train'").agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]]
    explained = M.linear_factors(scored.where("part = 'test'"), model, NUMBERS, WORDS, means)
    return M.importance(explained).select("factor", F.round("mean_abs", 6).alias("mean_abs"), F.round("share", 4).alias("share"))


def streamed_store(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed store of a user's latest event, kept up by a stream over the events' files."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    source = table(spark, sf, "events")
    source.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 100).parquet(f"{root}/landing")
    upsert_stream(stream, f"{root}/store", ["user_id"], "event_id", f"{root}/state").awaitTermination()
    return latest(spark, f"{root}/store").select("user_id", "event_id", "event_type")


QUERIES = {q.__name__: q for q in (formula_metrics, conformal_interval, split_sizes, predictions, factor_importance, streamed_store)}
ORACLE = {
    "formula_metrics": "SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(100 * avg(CASE WHEN y <> 0 THEN abs(e / y) END), 4) AS mape, round(1 - sum(e * e) / (var_pop(y) * count(y)), 4) AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500.0 AS e FROM lineitem)",
    "conformal_interval": "SELECT round(r, 8) AS width FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS p, count(*) OVER () AS n FROM (SELECT abs(ln(1 + l_extendedprice) - ln(1 + l_quantity * 1500.0)) AS r FROM lineitem)) WHERE p = ceil(least(ceil((n + 1) * 0.8) / n, 1.0) * (n - 1))",
    "streamed_store": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1",
}
