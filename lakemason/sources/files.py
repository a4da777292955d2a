"""File sources and sinks with the checks that messy inputs need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its own file system; FileNotFoundError for none."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Records of files that hold one JSON array; malformed files raise where ``strict``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_text_csv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """CSV with a header, all columns text, headers trimmed and in small letters, null as ''; missing columns raise."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = raw.toDF(*[c.strip().lstrip("\ufeff").lower() for c in raw.columns])
    lacking = [c for c in required if c not in out.columns]
    if lacking:
        raise ValueError(f"{path} lacks columns {lacking}")
    return out.select(*[F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"^\s+|\s+$", "")).alias(c) for c in out.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns in order: absent ones null, others dropped, values cast where they can be."""
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if isinstance(f.dataType, T.AtomicType) else F.col(f"`{f.name}`")).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def flat_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns ready for CSV: nested values as JSON text, null as ''."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if c not in kinds:
            out.append(F.lit("").alias(c))
        elif kinds[c].startswith(("array", "map", "struct")):
            out.append(F.coalesce(F.to_json(c), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flat_text(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_by_status(df: DataFrame, path: str, status: str = "record_status") -> DataFrame:
    """One folder a status; returns (status, n)."""
    df.write.mode("overwrite").partitionBy(status).parquet(path)
    return df.groupBy(status).agg(F.count("*").alias("n"))


def append_log(spark: SparkSession, path: str, entry: dict[str, str]) -> None:
    spark.createDataFrame([entry]).withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def read_pages(spark: SparkSession, path: str, number: str = r"search_(\d+)\.html") -> DataFrame:
    """(path, page, html) of cached pages, the page number from the file's name."""
    pages = spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
    return pages.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", number, 1).try_cast("int").alias("page"), F.col("value").alias("html"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain, url) of files with one address a line and an optional '# domain: ...' line before them."""
    whole = spark.read.text(path, wholetext=True)
    named = F.regexp_extract("value", r"(?m)^#\s*domain:\s*(\S+)", 1)
    from_file = F.regexp_extract("_metadata.file_name", r"^(.+?)(?:\.[^.]*)?$", 1)
    lines = whole.select(F.when(named != "", named).otherwise(F.regexp_replace(from_file, "_", ".")).alias("domain"), F.explode(F.split("value", r"\r?\n")).alias("url"))
    return lines.select("domain", F.trim("url").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def sitemap_urls(xml: str):
    """Addresses of a sitemap's <loc> elements, from a column of XML text."""
    return F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))


def unparsed(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Pages that no earlier run has parsed."""
    return pages.join(done.select(key), key, "left_anti")
