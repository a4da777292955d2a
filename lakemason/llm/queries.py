"""The llm queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.llm.canonical import MentionGazetteer, canonicalise, unmatched_report
from lakemason.llm.encoding import encode_corpus, tokenizer_folder
from lakemason.llm.leakage import find_leaks
from lakemason.llm.matching import match
from lakemason.llm.neardup import has_words, near_duplicates, near_pairs
from lakemason.llm.pii import find_details, revealing_terms, sanitise
from lakemason.llm.sentences import sentence_units
from lakemason.llm.survivor import long_form, survivors
from lakemason.operators.lookup import resolve_values
from lakemason.sources.tables import spread, table


def _districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clean_khmer24").where(F.col("listing_id").isNotNull())
    mapping = table(spark, sf_dir, "district_mapping")
    exact = mapping.select(F.col("standard_name").alias("district")).distinct()
    typed = rows.join(exact, "district", "left_anti")
    return canonicalise(typed, "listing_id", "district", mapping)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _districts(spark, sf_dir).select(F.col("key").alias("listing_id"), F.col("standard").alias("standard_name")).distinct()


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed districts that stand for no entry, with their number of adverts."""
    return unmatched_report(_districts(spark, sf_dir)).select(F.col("value").alias("district"), "n_keys")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clean_khmer24").where(F.col("duplicate_group_id").isNotNull())
    rows = rows.withColumn("plain", F.regexp_replace(F.lower(F.trim("source")), "-", "_"))
    names = resolve_values(rows, "district", table(spark, sf_dir, "district_mapping"), "raw_name", "standard_name", MentionGazetteer)
    rows = rows.join(names.select(F.col("value").alias("district"), F.col("standard").alias("meant")), "district", "left")
    priority = table(spark, sf_dir, "source_priority").select(F.lower(F.trim("source")).alias("plain"), "priority")
    rows = rows.join(priority, "plain", "left")
    fields = {"source": F.when(F.col("plain") != "", F.col("plain")), "bedrooms": F.col("bedrooms"), "unit_floor": F.col("unit_floor"), "district": F.col("meant")}
    return long_form(rows, "duplicate_group_id", fields, F.col("priority"), F.try_to_timestamp("listing_updated_at"))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values, with what decided each and among how many values."""
    return survivors(_held(spark, sf_dir)).select(F.col("grp").alias("duplicate_group_id"), "field_name", F.col("value").alias("field_value"), "basis", "n_values")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_survivors(spark, sf_dir).select("duplicate_group_id", "field_name", "field_value")


#: What stands fast of a flat: the same in every advert that is posted again.
FLAT = ["property_type", "bedrooms", "size_m2", "unit_floor"]


def _posted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, Column, Column]:
    """Adverts, their id, their text, and the flat that a text alone doesn't tell.

    A bare title ("new building 2BR") is shared by many flats: where there is no description,
    adverts are compared with those of a flat with the same facts, unknown ones included.
    """
    rows = table(spark, sf_dir, "clean_khmer24").select("listing_id", "title", "description", *FLAT)
    flat = F.xxhash64(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in FLAT]))
    return rows, "listing_id", F.concat_ws("\n", "title", "description"), F.when(~has_words(F.col("description")), flat)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(listing_id, class_id, n_links) of every advert that was posted again."""
    return near_duplicates(*_posted(spark, sf_dir)).withColumnRenamed("key", "listing_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs(*_posted(spark, sf_dir))
    return pairs.select(F.col("key_1").alias("listing_id_1"), F.col("key_2").alias("listing_id_2"))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an agency's and a classified advert for one flat, with rule and confidence."""
    pairs = match(table(spark, sf_dir, "clean_harbor"), table(spark, sf_dir, "clean_khmer24"))
    return pairs.select(F.least("left_id", "right_id").alias("listing_id_1"), F.greatest("left_id", "right_id").alias("listing_id_2"), "rule", F.round("confidence", 4).alias("confidence"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("listing_id_1", "listing_id_2").distinct()


def _texts_with_details(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "clean_khmer24").select("listing_id", "title", "description")
    return rows, revealing_terms(rows.select(F.concat_ws("\n", "title", "description").alias("text")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, terms = _texts_with_details(spark, sf_dir)
    return find_details(rows, "listing_id", ["title", "description"], terms).withColumnRenamed("key", "listing_id")


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts with typed placeholders instead of personal details."""
    rows, terms = _texts_with_details(spark, sf_dir)
    return sanitise(rows, ["title", "description"], terms)


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items they hold, and how much of each."""
    return find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode_corpus(documents, "doc_id", "text", f"{tokenizer_folder()}/byte_bpe_50k.tiktoken").select("doc_id", "ids")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    return sentence_units(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p2_plain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values of the fields that need no reference list."""
    return p2_found(spark, sf_dir).where("field_name <> 'district'")


QUERIES = {"p2_plain_fields": p2_plain_fields, "p10_found": p10_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p6_found": p6_found, "p6_redacted": p6_redacted, "p1_found": p1_found, "p1_matches": p1_matches, "p2_found": p2_found, "p2_survivors": p2_survivors, "p5_found": p5_found, "p5_classes": p5_classes, "p4_found": p4_found, "p4_unmatched": p4_unmatched}
_HELD = """
WITH m AS (SELECT duplicate_group_id AS g, replace(lower(trim(source)), '-', '_') AS s, bedrooms, unit_floor, try_cast(listing_updated_at AS TIMESTAMPTZ) AS u FROM clean_khmer24 WHERE duplicate_group_id IS NOT NULL),
h AS (SELECT m.*, coalesce(priority, -2147483648) AS p FROM m LEFT JOIN source_priority sp ON lower(trim(sp.source)) = m.s),
f AS (SELECT g, 'source' AS field_name, s AS v, p, u FROM h WHERE s <> '' UNION ALL SELECT g, 'bedrooms', CAST(bedrooms AS VARCHAR), p, u FROM h WHERE bedrooms IS NOT NULL UNION ALL SELECT g, 'unit_floor', CAST(unit_floor AS VARCHAR), p, u FROM h WHERE unit_floor IS NOT NULL)
SELECT g AS duplicate_group_id, field_name, arg_max(v, (p, u)) AS field_value FROM f GROUP BY 1, 2
"""
ORACLE: dict[str, str] = {"p2_plain_fields": _HELD}
