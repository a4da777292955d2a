"""Queries of sources, sinks, text helpers, reviews and pages, each beside the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemason.functions import extract as X
from lakemason.functions import html as H
from lakemason.functions import numeric as N
from lakemason.functions import text as S
from lakemason.operators import dedupe, evidence, joins, location, profile, resolve, review, rules, sequences
from lakemason.plans.matching import _BANDS, band_duplicates
from lakemason.sources import files
from lakemason.sources.tables import shared_folder, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _adverts(spark: SparkSession, sf: str, **made: Column) -> DataFrame:
    return table(spark, sf, "clean_khmer24").select("listing_id", *[c.alias(n) for n, c in made.items()])


# sources and sinks


def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON array written as one text and read back under a schema with a column it lacks."""
    place = _folder(spark)
    table(spark, sf, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name")))).write.text(f"{place}/regions")
    found = files.first_existing(spark, [f"{place}/nowhere", f"{place}/regions"])
    rows = files.read_json_array(spark, found, "r_regionkey long, r_name string, dropped string")
    return files.conform(rows.drop("dropped"), T.StructType().add("r_regionkey", T.IntegerType()).add("r_name", T.StringType()).add("note", T.StringType()))


def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    place = _folder(spark)
    files.write_json(table(spark, sf, "clean_harbor").select("listing_id", "title", "bedroom_options"), f"{place}/adverts")
    rows = spark.read.schema("listing_id string, title string, bedroom_options array<int>").json(f"{place}/adverts")
    return rows.select("listing_id", "title", F.size(F.coalesce("bedroom_options", F.array().cast("array<int>"))).alias("n_options"))


def csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with unkempt headers: all columns text, null as empty, nested values as JSON text."""
    place = _folder(spark)
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(" S_SuppKey\t"), F.col("s_name").alias("S_Name "), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")).alias("nation"), F.array("s_nationkey", "s_suppkey").alias("keys"))
    files.write_csv(rows, f"{place}/suppliers", [*rows.columns, "absent"])
    return files.read_text_csv(spark, f"{place}/suppliers", ["s_suppkey", "absent"])


def status_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written to a folder a status, counted as written and as read back."""
    place = _folder(spark)
    written = files.write_by_status(table(spark, sf, "clean_harbor").select("listing_id", "record_status"), f"{place}/by_status")
    read = spark.read.parquet(f"{place}/by_status").groupBy("record_status").agg(F.count("*").alias("n_read"))
    return written.join(read, "record_status").select("record_status", "n", "n_read")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    place = _folder(spark)
    for step in ("load", "clean"):
        files.append_log(spark, f"{place}/log", {"step": step, "note": "ok"})
    return spark.read.json(f"{place}/log").groupBy("step").agg(F.count("logged_at").alias("n"))


def sitemap_links(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(F.lit("<urlset><url>\n<loc> "), F.col("url"), F.lit(" </loc></url><url><LOC>"), F.col("url"), F.lit("/b</LOC></url></urlset>"))
    return table(spark, sf, "documents").where("url is not null").withColumn("xml", xml).select("doc_id", F.explode(files.sitemap_urls("xml")).alias("link"))


def unparsed_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return files.unparsed(pages, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), "k")


def missing_references(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"))
    return joins.missing_references(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), known, "k")


# text helpers


def first_names(spark: SparkSession, sf: str) -> DataFrame:
    """The first filled of several fields, and a default source."""
    return _adverts(spark, sf, place=S.first_filled(F.col("project_name"), F.col("location_text"), F.col("district")), label=F.coalesce("source", F.lit("unknown")), present=F.coalesce("title", F.col("price_usd").cast("string"), F.col("size_m2").cast("string"), "description").isNotNull())


def reasons_joined(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda c, n: F.when(F.col(c).isNull(), F.lit(n))
    reasons = S.ordered_reasons(flag("price_usd", "no_price"), flag("size_m2", "no_size"), flag("price_usd", "no_price"), flag("bedrooms", "no_rooms"))
    return _adverts(spark, sf, reasons=reasons, more=resolve.add_message(reasons, F.when(F.col("district").isNull(), "no_size")), text=S.evidence_text(F.col("district"), F.col("commune"), F.col("city"), sep="|"))


def shown_prices(spark: SparkSession, sf: str) -> DataFrame:
    page = F.pmod(F.length("url"), F.lit(3))
    return _adverts(spark, sf, shown=S.short_usd(F.col("price_usd")), page=S.page_url(F.lit("https://k24.example/list/"), page, "query"), path=S.page_url(F.lit("https://k24.example/list/"), page, "path"), paged=S.page_url(F.lit("https://k24.example/list/"), page, "paged"))


def tag_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words outside of tags, and the total that a page states."""
    page = F.concat(F.lit("<p>"), F.coalesce("project_name", F.lit("none")), F.lit("</p><b>about "), (F.col("n_chars") * 7).cast("string"), F.lit(" results</b>, 12 shown of "), F.col("n_chars").cast("string"), F.lit(" ads"))
    return table(spark, sf, "documents").select("doc_id", S.word_count(page).alias("n_words"), S.stated_total(page, [r"about ([\d,]+) results", r"of ([\d,]+) ads"]).alias("total"))


def card_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without their cards' age; addresses without trailing words."""
    return _adverts(spark, sf, bare=S.strip_suffixes(F.col("title"), S.AGE_ENDINGS), short=S.collapse_repeat(F.concat(F.lit("Quay Court "), F.col("listing_id"), F.lit(" 7 Quay Court "), F.col("listing_id"), F.lit(" x"))))


def resolved_places(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by alias, part and the longest alias within a text."""
    aliases, parts = {"Germany": "DE", "United Kingdom": "UK", "Kingdom": "K"}, {"France": "EU"}
    text = F.concat(F.lit("the "), F.initcap("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", S.resolve_place(F.col("n_name"), aliases, parts).alias("own"), S.resolve_place(text, aliases, parts).alias("within"))


def labelled_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and values behind labels, and wholes that all named parts agree on."""
    size = F.concat(F.lit("Net area: "), F.col("size_m2").cast("decimal(12,2)").cast("string"), F.lit(" sqm; Floor: "), F.col("unit_floor").cast("string"), F.lit(" | x"))
    return _adverts(spark, sf, area=X.near_label(size, "net area|size"), floor=X.label_value(size, "Floor"), side=X.agreed_label(F.col("title"), {"residence": "living", "suites": "living", "tower": "high"}))


def room_options(spark: SparkSession, sf: str) -> DataFrame:
    """Several room counts in one title; rooms not behind a banned word; options in order."""
    n = F.pmod(F.length("title"), F.lit(4)) + 1
    text = F.concat(F.lit("nice "), n.cast("string"), F.lit(" & "), (n + 1).cast("string"), F.lit(" bedrooms, maid 5 beds"))
    options = X.option_list(F.array(n, F.col("bedrooms"), n, F.lit(-1)))
    return _adverts(spark, sf, listed=F.array_join(X.bedroom_options(text), ","), options=F.array_join(options, ","), rooms=X.rooms_not_after(text, r"(\d{1,2})\s*bed", "maid"))


def compared_prices(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.relative_difference(a, b), 4).alias("apart"), N.values_differ(a, b, 50.0, 0.02).alias("differ"), N.is_close(a, b, 0.05, 1.0).alias("near"), N.discount_percent(a, b).alias("cut"), N.to_number(F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") > 4, "x").otherwise(""))).alias("number"))
    return rows.groupBy("differ", "near").agg(F.count("*").alias("n"), F.round(F.avg("apart"), 4).alias("apart"), F.round(F.avg("cut"), 2).alias("cut"), F.sum("number").alias("numbers"))


# reviews


def decision_problems(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, " Approve").when(F.col("c_custkey") % 3 == 1, "reject").otherwise("later")
    rows = table(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("k"), kind.alias("decision"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).alias("note"))
    return review.decision_problems(rows, "k", "decision", "note", ["approve", "reject"])


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    keep = F.when(k % 3 == 0, k % 90).when(k % 3 == 1, (k % 70) + 100)
    return table(spark, sf, "customer").select((k % 90).alias("a"), ((k % 70) + 100).alias("b"), keep.alias("keep_listing_id"), F.when(k % 5 > 0, " Duplicate").otherwise("different").alias("manual_decision"))


def pair_actions(spark: SparkSession, sf: str) -> DataFrame:
    return review.pair_actions(_decided(spark, sf))


def conflicting_actions(spark: SparkSession, sf: str) -> DataFrame:
    return review.conflicting_actions(review.pair_actions(_decided(spark, sf)))


def pair_members(spark: SparkSession, sf: str) -> DataFrame:
    """How many adverts stand on either side of the pairs."""
    both = band_duplicates(spark, sf)
    return both.select(F.explode(F.array("a", "b")).alias("id")).agg(F.count_distinct("id").alias("ids"))


def overridden_nations(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return location.overrides(nation, "n_nationkey", "n_name", nation.where("n_nationkey < 4").withColumn("n_name", F.lower("n_name"))).select("n_nationkey", "n_name")


def duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates get a status of their own and lose their reasons."""
    rows = rules.classify(table(spark, sf, "lineitem"), [rules.Rule("bulk", "review", F.col("l_quantity") > 40), rules.Rule("free", "reject", F.col("l_discount") > 0.09)])
    rows = rules.mark_duplicates(rows, F.col("l_linenumber") > 5)
    return rows.groupBy("record_status", "needs_review", F.array_join(F.concat("reject_reasons", "review_reasons"), ";").alias("reasons")).agg(F.count("*").alias("n"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("price_conflict"), F.when(k % 3 == 0, "a=1"), F.lit("size_conflict"), F.when(k % 4 == 0, " ").otherwise("b=2"), F.lit("floor"), F.lit("c=3"), F.lit("rooms_conflict"), F.when(k % 5 == 0, "d=4"))
    return table(spark, sf, "customer").select("c_custkey", fields.alias("fields"))


def conflict_keys(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.conflict_counts(_messages(spark, sf), "fields")


def open_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).select("c_custkey", F.array_join(resolve.open_conflicts(F.col("fields"), ["size"]), ",").alias("open"))


def evidence_columns(spark: SparkSession, sf: str) -> DataFrame:
    """In how many rows each column says something, and in how many all agree."""
    found = location.evidence({"district": F.lower("district"), "commune": F.lower("commune"), "city": F.lower("city")})
    rows = table(spark, sf, "clean_khmer24").select(found.alias("e"))
    agreed = rows.where(location.consistent(F.col("e"))).select(F.lit("(agreed)").alias("column")).groupBy("column").agg(F.count("*").alias("n"))
    return evidence.evidence_counts(rows, "e").unionByName(agreed)


def judged_estimates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumns({"estimate": F.col("l_quantity") * 1500.0, "low": F.col("l_quantity") * 1200.0, "high": F.col("l_quantity") * 1800.0})
    rows = evidence.validated(rows, [("bulk", F.col("l_quantity") > 45)], [("cut", F.col("l_discount") > 0.05), ("taxed", F.col("l_tax") > 0.05)])
    rows = evidence.scored_estimates(rows, "l_extendedprice", "estimate", "low", "high")
    return rows.groupBy("status", "error", F.array_join("warnings", ";").alias("warnings"), "inside_range").agg(F.count("*").alias("n"), F.round(F.avg("absolute_error"), 2).alias("absolute_error"), F.round(F.avg("percentage_error"), 4).alias("percentage_error"))


# order and sequences


def largest_orders(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.largest(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


def stop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Where a crawl stops: lines as pages of their supplier's site, parts as links."""
    pages = table(spark, sf, "lineitem").where("l_suppkey is not null").groupBy(F.col("l_suppkey").alias("site"), F.month("l_shipdate").alias("page")).agg(F.collect_set(F.col("l_partkey") % 60).alias("links"))
    return sequences.stop_page(pages, "site", "page", "links")


def fresh_links(spark: SparkSession, sf: str) -> DataFrame:
    """Does a second page bring enough that the first one hasn't?"""
    first = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set(F.col("c_custkey") % 50).alias("one"))
    second = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_set(F.col("s_suppkey") % 70).alias("two"))
    return first.join(second, "nation").select("nation", joins.new_items(F.col("one"), F.col("two")).alias("moves_on"))


# pages and nested values


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    item = F.to_json(F.struct(F.col("listing_id").alias("id"), F.col("price_usd").alias("price"), F.coalesce("bedrooms", F.lit(0)).alias("bedrooms")))
    nested = F.concat(F.lit('{"props":{"list":[{"x":1},'), item, F.lit("]}}"))
    html = F.concat(F.lit('<html><head><script id="__NEXT_DATA__" type="application/json">'), nested, F.lit('</script><script type="application/ld+json">{"offers":{"price":'), F.coalesce(F.col("price_usd").cast("long").cast("string"), F.lit("0")), F.lit("}}</script></head><body><table><tr><th>Rooms</th><td>"), F.coalesce(F.col("bedrooms").cast("string"), F.lit("?")), F.lit("</td></tr></table></body></html>"))
    return table(spark, sf, "clean_harbor").select("listing_id", nested.alias("nested"), html.alias("html"))


def embedded_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records within a page's JSON: by script id, by walking it, by the weight of its keys."""
    rows = _pages(spark, sf).select("listing_id", H.embedded_json(F.col("html"), "__NEXT_DATA__").alias("nested"), H.json_ld(F.col("html")).alias("ld"), H.page_records_column(F.col("html")).alias("page"))
    one = F.get(H.records_column(F.col("nested")), F.lit(0))
    return rows.select("listing_id", F.get_json_object(one, "$.id").alias("id"), F.get_json_object(one, "$.bedrooms").cast("int").alias("rooms"), F.get_json_object(F.get("ld", F.lit(0)), "$.offers.price").cast("long").alias("offer"), "page.method", F.size("page.records").alias("n_records"))


def nested_names(spark: SparkSession, sf: str) -> DataFrame:
    """A readable text of nested values: of a list's first element, of a name, of the text itself."""
    value = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.array(F.struct(F.col("n_name").alias("name"))))).when(F.col("n_nationkey") % 3 == 1, F.to_json(F.struct(F.struct(F.lower("n_name").alias("en")).alias("title")))).otherwise(F.col("n_name"))
    flat = F.pandas_udf(lambda s: s.map(H.flatten_value), "string")
    return table(spark, sf, "nation").select("n_nationkey", flat(value).alias("flat"))


# statistics


def status_by_type_and_source(spark: SparkSession, sf: str) -> DataFrame:
    """A crosstab with two levels of rows."""
    return profile.crosstab(table(spark, sf, "clean_harbor"), ["property_type", "listing_type"], "record_status", ["accepted", "review", "rejected"], "none")


def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlations of every pair of columns."""
    rows, columns, out = table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            one = profile.spearman(rows, a, b)
            out = one if out is None else out.unionByName(one)
    return out


def log_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Regression metrics in log space."""
    rows = table(spark, sf, "lineitem").select(F.log1p("l_extendedprice").alias("y"), F.log1p(F.col("l_quantity") * 1500.0).alias("p"))
    return profile.regression_metrics(rows, "y", "p").select(*[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


def url_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.lower("url")
    return evidence.cohorts(table(spark, sf, "clean_khmer24"), {"sale": u.contains("sale"), "rent": u.contains("rent"), "condo": u.contains("condo"), "numbered": u.rlike("[0-9]{4,}"), "loose": u.contains("sale") | u.contains("condo"), "unknown": u.isNull()})


def exact_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that repeat another in every column, nested ones included."""
    return dedupe.exact_duplicate_rows(table(spark, sf, "clean_khmer24"))


QUERIES = {q.__name__: q for q in (
    json_records, json_sink, csv_texts, status_files, run_log, sitemap_links, unparsed_keys, missing_references, first_names, reasons_joined, shown_prices, tag_words, card_titles, resolved_places, labelled_values, room_options, compared_prices, decision_problems, pair_actions,
    conflicting_actions, pair_members, overridden_nations, duplicate_lines, conflict_keys, open_conflicts, evidence_columns, judged_estimates, largest_orders, stop_pages, fresh_links, embedded_records, nested_names, status_by_type_and_source, spearman_matrix, log_metrics, url_cohorts, exact_copies,
)}

_DECIDED = "WITH d AS (SELECT c_custkey % 90 AS a, c_custkey % 70 + 100 AS b, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 90 WHEN 1 THEN c_custkey % 70 + 100 END AS k FROM customer WHERE c_custkey % 5 > 0), p AS (SELECT DISTINCT CASE WHEN k = a THEN b WHEN k = b THEN a END AS remove_id, k AS keep_id FROM d WHERE k IS NOT NULL) "
_RANKS = "SELECT '{0}' AS a, '{1}' AS b, round(corr(x, y), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0 AS y FROM lineitem WHERE {0} IS NOT NULL AND {1} IS NOT NULL)"
_RENDERED = "concat_ws('|', coalesce(district, ''), coalesce(commune, ''), coalesce(city, ''))"
_COHORT = {"sale": "lower(url) LIKE '%sale%'", "rent": "lower(url) LIKE '%rent%'", "condo": "lower(url) LIKE '%condo%'", "numbered": "regexp_matches(url, '[0-9]{4,}')", "loose": "lower(url) LIKE '%sale%' OR lower(url) LIKE '%condo%'", "unknown": "url IS NULL"}
ORACLE = {
    "json_records": "SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region",
    "json_sink": "SELECT listing_id, title, coalesce(len(bedroom_options), 0) AS n_options FROM clean_harbor",
    "csv_texts": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_nationkey > 5 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS nation, concat('[', s_nationkey, ',', s_suppkey, ']') AS keys, '' AS absent FROM supplier",
    "status_files": "SELECT record_status, count(*) AS n, count(*) AS n_read FROM clean_harbor GROUP BY 1",
    "run_log": "SELECT * FROM (VALUES ('load', 1), ('clean', 1)) t(step, n)",
    "sitemap_links": "SELECT doc_id, unnest([url, concat(url, '/b')]) AS link FROM documents WHERE url IS NOT NULL",
    "unparsed_keys": "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "missing_references": "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
    "first_names": "SELECT listing_id, CASE WHEN trim(project_name) <> '' THEN project_name WHEN trim(location_text) <> '' THEN location_text WHEN trim(district) <> '' THEN district END AS place, coalesce(source, 'unknown') AS label, title IS NOT NULL OR price_usd IS NOT NULL OR size_m2 IS NOT NULL OR description IS NOT NULL AS present FROM clean_khmer24",
    "reasons_joined": f"WITH r AS (SELECT *, nullif(concat_ws('; ', CASE WHEN price_usd IS NULL THEN 'no_price' END, CASE WHEN size_m2 IS NULL THEN 'no_size' END, CASE WHEN bedrooms IS NULL THEN 'no_rooms' END), '') AS reasons FROM clean_khmer24) SELECT listing_id, reasons, CASE WHEN district IS NULL AND size_m2 IS NOT NULL THEN concat_ws('; ', reasons, 'no_size') ELSE reasons END AS more, {_RENDERED} AS text FROM r",
    "shown_prices": "WITH p AS (SELECT listing_id, price_usd AS v, length(url) % 3 AS n FROM clean_khmer24) SELECT listing_id, CASE WHEN v >= 1e6 THEN printf('$%.1fM', round(v / 1e6, 1)) WHEN v >= 1e3 THEN printf('$%.1fK', round(v / 1e3, 1)) WHEN v IS NOT NULL THEN printf('$%.0f', v) END AS shown, CASE WHEN n <= 1 THEN 'https://k24.example/list/' WHEN n > 1 THEN 'https://k24.example/list?page=' || n END AS page, CASE WHEN n <= 1 THEN 'https://k24.example/list/' WHEN n > 1 THEN 'https://k24.example/list/' || n END AS path, CASE WHEN n <= 1 THEN 'https://k24.example/list/' WHEN n > 1 THEN 'https://k24.example/list/page/' || n || '/' END AS paged FROM p",
    "tag_words": r"SELECT doc_id, CASE WHEN n_chars IS NOT NULL THEN len(list_filter(regexp_split_to_array(coalesce(project_name, 'none'), '[ \t\n\r\x0b\f]+'), lambda x: x <> '')) + 9 END AS n_words, (SELECT max(v) FROM unnest([n_chars * 7, n_chars]) u(v) WHERE v BETWEEN 5 AND 200000 AND v NOT BETWEEN 1900 AND 2100) AS total FROM documents",
    "card_titles": r"SELECT listing_id, nullif(trim(regexp_replace(trim(regexp_replace(title, '\s*(?:\d+\s*(?:m|h|d|w|mo|y)\s*•)\s*$', '', 'i')), '\s*(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}\s*•)\s*$', '', 'i')), '') AS bare, 'Quay Court ' || listing_id AS short FROM clean_khmer24",
    "resolved_places": "SELECT n_nationkey, CASE n_name WHEN 'GERMANY' THEN 'DE' WHEN 'UNITED KINGDOM' THEN 'UK' WHEN 'FRANCE' THEN 'EU' ELSE t END AS own, CASE n_name WHEN 'GERMANY' THEN 'DE' WHEN 'UNITED KINGDOM' THEN 'UK' WHEN 'FRANCE' THEN 'EU' ELSE 'The ' || t END AS within FROM (SELECT n_nationkey, n_name, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS t FROM nation)",
    "labelled_values": "SELECT listing_id, CASE WHEN unit_floor IS NOT NULL THEN CAST(CAST(size_m2 AS DECIMAL(12,2)) AS DOUBLE) END AS area, CASE WHEN size_m2 IS NOT NULL THEN CAST(unit_floor AS VARCHAR) END AS floor, CASE WHEN (lower(title) LIKE '%residence%' OR lower(title) LIKE '%suites%') AND lower(title) LIKE '%tower%' THEN NULL WHEN lower(title) LIKE '%residence%' OR lower(title) LIKE '%suites%' THEN 'living' WHEN lower(title) LIKE '%tower%' THEN 'high' END AS side FROM clean_khmer24",
    "room_options": "SELECT listing_id, n || ',' || (n + 1) AS listed, array_to_string(list_sort(list_distinct(list_filter([n, bedrooms], lambda x: x >= 0))), ',') AS options, CAST(n + 1 AS INTEGER) AS rooms FROM (SELECT listing_id, bedrooms, length(title) % 4 + 1 AS n FROM clean_khmer24)",
    "compared_prices": "WITH v AS (SELECT *, l_extendedprice / l_quantity AS a, l_extendedprice * (1 - l_discount) / l_quantity AS b FROM lineitem), r AS (SELECT abs(a - b) > greatest(50.0, 0.02 * greatest(abs(a), abs(b))) AS differ, abs(a - b) <= greatest(0.05 * greatest(abs(a), abs(b)), 1.0) AS near, round(abs(a - b) / greatest(a, b), 4) AS apart, CASE WHEN b < a THEN round(100 * (a - b) / a, 2) END AS cut, CASE WHEN l_linenumber <= 4 THEN CAST(l_quantity AS DOUBLE) END AS number FROM v) SELECT differ, near, count(*) AS n, round(avg(apart), 4) AS apart, round(avg(cut), 2) AS cut, sum(number) AS numbers FROM r GROUP BY 1, 2",
    "decision_problems": "WITH r AS (SELECT c_custkey % 500 AS k, c_custkey % 3 <> 2 AS known, c_custkey % 7 = 0 AS blank FROM customer), g AS (SELECT k, bool_and(known) AS known, bool_or(blank) AS blank, count(*) AS n FROM r GROUP BY 1) SELECT k, 'unknown_decision' AS problem FROM g WHERE NOT known UNION ALL SELECT k, 'missing_note' FROM g WHERE blank UNION ALL SELECT k, 'repeated' FROM g WHERE n > 1",
    "pair_actions": _DECIDED + "SELECT remove_id, keep_id FROM p",
    "conflicting_actions": _DECIDED + "SELECT remove_id, count(DISTINCT keep_id) AS n_keep FROM p GROUP BY 1 HAVING count(DISTINCT keep_id) > 1",
    "pair_members": _BANDS + "SELECT count(DISTINCT id) AS ids FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p)",
    "overridden_nations": "SELECT n_nationkey, CASE WHEN n_nationkey < 4 THEN lower(n_name) ELSE n_name END AS n_name FROM nation",
    "duplicate_lines": "WITH r AS (SELECT l_linenumber > 5 AS d, l_discount > 0.09 AS f, l_quantity > 40 AS b FROM lineitem) SELECT CASE WHEN d THEN 'duplicate' WHEN f THEN 'rejected' WHEN b THEN 'review' ELSE 'accepted' END AS record_status, NOT d AND NOT f AND b AS needs_review, CASE WHEN d THEN '' ELSE concat_ws(';', CASE WHEN f THEN 'free' END, CASE WHEN b THEN 'bulk' END) END AS reasons, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "conflict_keys": "SELECT * FROM (SELECT 'price_conflict' AS key, count(*) FILTER (WHERE c_custkey % 3 = 0) AS n FROM customer UNION ALL SELECT 'size_conflict', count(*) FILTER (WHERE c_custkey % 4 <> 0) FROM customer UNION ALL SELECT 'rooms_conflict', count(*) FILTER (WHERE c_custkey % 5 = 0) FROM customer) WHERE n > 0",
    "open_conflicts": "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'price' END, CASE WHEN c_custkey % 5 = 0 THEN 'rooms' END) AS open FROM customer",
    "evidence_columns": "WITH e AS (SELECT lower(district) AS d, lower(commune) AS m, lower(city) AS c FROM clean_khmer24), r AS (SELECT 'district' AS column, count(d) AS n FROM e UNION ALL SELECT 'commune', count(m) FROM e UNION ALL SELECT 'city', count(c) FROM e UNION ALL SELECT '(agreed)', count(*) FILTER (WHERE len(list_distinct([d, m, c])) = 1) FROM e) SELECT * FROM r WHERE n > 0",
    "judged_estimates": "WITH r AS (SELECT CASE WHEN l_quantity > 45 THEN 'error' ELSE 'ok' END AS status, CASE WHEN l_quantity > 45 THEN 'bulk' END AS error, concat_ws(';', CASE WHEN l_discount > 0.05 THEN 'cut' END, CASE WHEN l_tax > 0.05 THEN 'taxed' END) AS warnings, l_extendedprice BETWEEN l_quantity * 1200.0 AND l_quantity * 1800.0 AS inside_range, abs(l_quantity * 1500.0 - l_extendedprice) AS e, l_extendedprice AS y FROM lineitem) SELECT status, error, warnings, inside_range, count(*) AS n, round(avg(e), 2) AS absolute_error, round(avg(100 * e / abs(y)), 4) AS percentage_error FROM r GROUP BY 1, 2, 3, 4",
    "largest_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "stop_pages": "WITH p AS (SELECT DISTINCT l_suppkey AS site, month(l_shipdate) AS page, l_partkey % 60 AS link FROM lineitem WHERE l_suppkey IS NOT NULL), f AS (SELECT site, page, count(*) AS fresh FROM (SELECT site, link, min(page) AS page FROM p GROUP BY 1, 2) GROUP BY 1, 2), c AS (SELECT g.site, g.page, coalesce(fresh, 0) AS fresh FROM (SELECT DISTINCT site, page FROM p) g LEFT JOIN f USING (site, page)), w AS (SELECT *, fresh + lag(fresh) OVER (PARTITION BY site ORDER BY page) AS two FROM c) SELECT site, coalesce(min(page) FILTER (WHERE two = 0), max(page)) AS last_page FROM w GROUP BY 1",
    "fresh_links": "WITH a AS (SELECT c_nationkey AS nation, list(DISTINCT c_custkey % 50) AS one FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, list(DISTINCT s_suppkey % 70) AS two FROM supplier GROUP BY 1) SELECT nation, len(list_filter(two, lambda x: NOT list_contains(one, x))) >= greatest(3, ceil(0.3 * len(one))) AS moves_on FROM a JOIN b USING (nation)",
    "embedded_records": "SELECT listing_id, CASE WHEN price_usd IS NOT NULL THEN listing_id END AS id, CASE WHEN price_usd IS NOT NULL THEN coalesce(bedrooms, 0) END AS rooms, coalesce(CAST(trunc(price_usd) AS BIGINT), 0) AS offer, CASE WHEN price_usd IS NOT NULL THEN 'json' ELSE 'pairs' END AS method, 1 AS n_records FROM clean_harbor",
    "nested_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name END AS flat FROM nation",
    "status_by_type_and_source": "SELECT property_type, listing_type, count(*) FILTER (WHERE record_status = 'accepted') AS accepted, count(*) FILTER (WHERE record_status = 'review') AS review, count(*) FILTER (WHERE record_status = 'rejected') AS rejected FROM clean_harbor GROUP BY 1, 2",
    "spearman_matrix": " UNION ALL ".join(_RANKS.format(a, b) for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))),
    "log_metrics": "SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(y)), 6) AS r2 FROM (SELECT ln(1 + l_extendedprice) AS y, ln(1 + l_extendedprice) - ln(1 + l_quantity * 1500.0) AS e FROM lineitem)",
    "url_cohorts": " UNION ALL ".join(f"SELECT '{n}' AS cohort, count(*) FILTER (WHERE {c}) AS n FROM clean_khmer24" for n, c in _COHORT.items()),
    "exact_copies": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean_khmer24)) AS duplicate_rows FROM clean_khmer24",
}
