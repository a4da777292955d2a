"""Numbering, ranking and stopping rules over ordered rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemason.sources.tables import cut_lineage


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in a total order, by a range sort and counts of its parts.

    The sorted rows are materialised once, so that numbers and rows can't drift apart. Give an
    order without ties where the numbers must be the same on every run.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a part
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + inside + 1).drop("_id", "_part", "_before")


def pair_ids(pairs: DataFrame, order: list[Column], name: str = "pair_id") -> DataFrame:
    """pair_00001, pair_00002, ... in order."""
    return numbered(pairs, order, "_no").withColumn(name, F.format_string("pair_%05d", F.col("_no"))).drop("_no")


def largest(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest values, ties by the smallest ``tie``; nulls last."""
    return df.orderBy(F.desc_nulls_last(column), tie).limit(k)


def stop_page(pages: DataFrame, site: str, page: str, links: str, empty_runs: int = 2) -> DataFrame:
    """(site, last_page): where a crawl stops, after so many pages in a row without a new link.

    Sites whose pages keep bringing new links end at their last page.
    """
    seen = pages.select(site, page, F.explode_outer(links).alias("link"))
    first = seen.where("link is not null").groupBy(site, "link").agg(F.min(page).alias(page))
    fresh = first.groupBy(site, page).agg(F.count("*").alias("new"))
    counts = pages.select(site, page).distinct().join(fresh, [site, page], "left").fillna(0, ["new"])
    run = Window.partitionBy(site).orderBy(page).rowsBetween(-(empty_runs - 1), 0)  # pages of one site
    dry = counts.withColumn("_dry", (F.sum("new").over(run) == 0) & (F.count("*").over(run) == empty_runs))
    return dry.groupBy(site).agg(F.coalesce(F.min(F.when(F.col("_dry"), F.col(page))), F.max(page)).alias("last_page"))
