"""De-duplication, joins, set operations and blocked pair matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.functions import numeric as N
from lakemason.functions import text as T
from lakemason.operators import counted, dedupe, evidence, joins, pairs, review, scored, sequences
from lakemason.sources.tables import cut_lineage, table

SIDES = ["district", "bedrooms", "bathrooms", "unit_floor", "price_usd", "size_m2", "property_type", "title_key", "letters"]


def first_adverts(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.first_rows(table(spark, sf, "documents").where("text is not null"), ["text"], [F.col("doc_id")])
    return rows.select("doc_id", "source")


def repeated_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.repeated(table(spark, sf, "validated_project_coordinates"), ["latitude", "longitude"])
    return rows.select("coord_id", "is_repeated")


def folded_adverts(spark: SparkSession, sf: str) -> DataFrame:
    """The exact sequential fold over id, address and code, in the order in which rows were read."""
    rows = table(spark, sf, "clean_khmer24").select("listing_id", T.normalize_url(F.col("url")).alias("url"), F.col("source_listing_code").alias("code"), "scraped_at")
    numbered = cut_lineage(rows.withColumn("seq", F.monotonically_increasing_id()))
    return dedupe.sequential_fold(numbered, "seq", ["listing_id", "url", "code"], "k24").select("seq", "listing_id", "url", "code", "scraped_at", "duplicate_reason", "duplicate_group_id")


def all_adverts(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "clean_khmer24").unionByName(table(spark, sf, "clean_harbor"))
    return both.groupBy("record_status").agg(F.count("*").alias("n"), F.count_distinct("listing_id").alias("ids"))


def kept_and_removed(spark: SparkSession, sf: str) -> DataFrame:
    harbor = table(spark, sf, "clean_harbor")
    removed, kept = joins.split_by_ids(harbor.select("listing_id", "project_name"), "project_name", table(spark, sf, "clean_khmer24").select("project_name").where("project_name is not null"))
    return removed.withColumn("side", F.lit("removed")).unionByName(kept.withColumn("side", F.lit("kept"))).groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("listing_id").alias("ids"))


def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return joins.coverage_problems(left, right, "k").groupBy("problem").agg(F.count("*").alias("n"))


def merged_customers(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("c_name"), "c_acctbal")
    updates = table(spark, sf, "customer").where("c_nationkey < 10").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return joins.merge_nonempty(base, updates, "c_custkey", {"c_acctbal"}).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = joins.upsert_last(events.where("event_type <> 'purchase'"), events.where("event_type = 'purchase'"), ["user_id"], "event_id")
    return rows.select("user_id", "event_id", "event_type")


def filled_names(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))
    return joins.fill_from_map(rows, "c_nationkey", "c_mktsegment", nation, source="nation").select("c_custkey", "c_mktsegment", "c_mktsegment_source")


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Adverts of both sources, one row an id, with their block keys and what these are made of."""
    def side(name: str) -> DataFrame:
        rows = table(spark, sf, name).where("title is not null")
        one = dedupe.first_rows(rows.select("listing_id", "title", *[c for c in SIDES if c not in ("title_key", "letters")]), ["listing_id"], [F.col("title"), F.col("price_usd")])
        return one.withColumn("source", F.lit(name))

    rows = side("clean_khmer24").unionByName(side("clean_harbor")).withColumn("title_key", T.title_key(F.col("title"))).withColumn("letters", pairs.letter_counts("title_key"))
    plain = lambda other: F.nullif(F.trim(F.regexp_replace(F.lower("district"), other, " ")), F.lit(""))
    kind, rooms = F.coalesce(F.lower(F.trim("property_type")), F.lit("")), F.col("bedrooms")
    place = F.coalesce(plain(r"[^a-z0-9]+"), plain(r"[^\p{L}\p{M}\p{N}]+"))
    parts = {"kind": kind, "place": place, "size_band": N.half_even_band(F.col("size_m2"), 5.0), "price_band": N.half_even_band(F.col("price_usd"), 10000.0), "words": pairs.longest_words(F.col("title_key"))}
    bands = {"size": ([kind, rooms], N.neighbour_bands(F.col("size_m2"), 5.0)), "price": ([kind, place], N.neighbour_bands(F.col("price_usd"), 10000.0)), "word": ([kind], parts["words"])}
    keys = pairs.block_keys({"place": [kind, place, rooms]}, bands)
    return rows.withColumns(parts | {"blocks": keys})


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(_keyed(spark, sf))


def blocked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs across sources in one district, room count and neighbouring size band."""
    rows = _both(spark, sf).where("property_type is not null and district is not null and bedrooms is not null and size_m2 is not null")
    keys = pairs.block_keys({}, {"size": ([F.col("property_type"), F.col("district"), F.col("bedrooms")], N.neighbour_bands(F.col("size_m2"), 5.0))})
    return pairs.candidate_pairs(rows.withColumn("blocks", keys), "listing_id", "source", "blocks")


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs across sources that score 60 or more, or meet a strong combination of conditions."""
    rows = _keyed(spark, sf).where("listing_id is not null").withColumn("side", (F.col("source") == "clean_khmer24").cast("int"))
    rows = cut_lineage(rows.select("listing_id", "side", "kind", "place", "size_band", "price_band", "words", *[c for c in SIDES if c != "letters"]))
    n_tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = scored.scored(rows, n_tasks).withColumn("title_sim", F.round("likeness", 4))
    sim = F.col("title_sim")
    points = [("facts", F.lit(True), F.col("base")), *[(name, sim >= least, weight) for name, least, weight in scored.TITLES]]
    core = F.col("sure") | (F.col("near") & (sim >= 0.84))
    return pairs.score(met, points, scored.LEAST, [(85.0, "high"), (70.0, "medium")], core).select("a", "b", "score", "confidence", "title_sim")


def judged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The strict tree: the first failing test names the outcome."""

    def early(both) -> Column:
        def differ(c: str) -> Column:
            a, b = both(c)
            return a.isNotNull() & b.isNotNull() & (a != b)

        tests = [
            ("district_conflict", differ("district")), ("bedrooms_conflict", differ("bedrooms")), ("floors_conflict", differ("unit_floor")),
            ("price_differs", ~pairs.close(*both("price_usd"), 0.03)), ("size_differs", ~pairs.close(*both("size_m2"), 0.03, 2.0)),
        ]
        floors = both("unit_floor")
        return pairs.first_failing([*tests, ("floors", floors[0].isNotNull() & floors[1].isNotNull())], "no_floors")

    # pairs are counted by what their rows have in common; listed, for their titles, where no earlier test decides
    rows = _keyed(spark, sf).where("listing_id is not null").withColumn("side", (F.col("source") == "clean_khmer24").cast("int"))
    codes = cut_lineage(counted.coded(rows, "kind", "place"))
    n_tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    passed, late = cut_lineage(counted.counted_levels(codes, n_tasks)), cut_lineage(counted.compared_titles(codes, n_tasks))
    tests = ["district_conflict", "bedrooms_conflict", "floors_conflict", "price_differs", "size_differs"]
    named = F.array(*[F.lit(t) for t in tests])
    failed = passed.select(F.get(named, F.col("level")).alias("outcome"), "n").unionByName(passed.where("level > 0").select(F.get(named, F.col("level") - 1).alias("outcome"), (-F.col("n")).alias("n")))
    failed = failed.unionByName(late.select(F.lit("size_differs").alias("outcome"), (-F.col("n")).alias("n")))
    shared = cut_lineage(codes.groupBy("listing_id").agg(F.count("*").alias("n")).where("n > 1").select("listing_id"))
    if not shared.isEmpty():  # an id of both sources is no pair
        twice = rows.join(shared, "listing_id")
        left, right = (twice.where(F.col("side") == k).select("listing_id", F.col("blocks").alias(f"blocks_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in SIDES]) for k in (0, 1))
        one = left.join(right, "listing_id").where(F.arrays_overlap("blocks_0", "blocks_1")).select(early(lambda c: (F.col(f"{c}_0"), F.col(f"{c}_1"))).alias("test"))
        still = F.when(F.col("test").isin("floors", "no_floors"), F.lit("size_differs")).otherwise(F.col("test"))
        failed = failed.unionByName(one.groupBy(still.alias("outcome")).agg((-F.count("*")).alias("n")))
    return failed.unionByName(late).groupBy("outcome").agg(F.sum("n").alias("n")).where("n > 0")


def pair_sources(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "nation").select(F.col("n_name").alias("x"), "n_regionkey")
    met = one.join(one.select(F.col("x").alias("y"), "n_regionkey"), "n_regionkey").where("x <> y")
    return met.groupBy(pairs.pair_label(F.col("x"), F.col("y")).alias("pair")).agg(F.count("*").alias("n"))


def band_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.first_rows(table(spark, sf, "clean_harbor").select("listing_id", "district", "bedrooms", "size_m2", "price_usd"), ["listing_id"], [F.col("price_usd"), F.col("size_m2")])
    return dedupe.band_pairs(rows, "listing_id", ["district", "bedrooms"], "size_m2", 2.0, "price_usd", 0.03)


def signature_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_khmer24").withColumn("signature", dedupe.signature(["title", "price_usd", "size_m2"], ["bedrooms", "district"]))
    return rows.where("signature is not null").groupBy("signature").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def applied_corrections(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    given = rows.where("s_suppkey % 7 = 0").select("s_suppkey", F.lit("12.5").alias("corrected_s_acctbal"), F.when(F.col("s_suppkey") % 2 == 0, "9").otherwise("no").alias("corrected_s_nationkey"))
    return review.apply_corrections(rows, given, "s_suppkey", {"s_acctbal": "double", "s_nationkey": "int"}).select("s_suppkey", "s_nationkey", "s_acctbal", "notes")


def manual_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_harbor").where("record_status = 'review'")
    return review.review_queue(rows, ["listing_id", "source", "title", "price_usd", "review_reason"], ["price_usd"], [F.col("listing_id")], "title").select("listing_id", "title", "review_reason", "manual_decision")


def numbered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pair ids in order of price difference and ids."""
    both = band_duplicates(spark, sf)
    return sequences.pair_ids(both, [F.col("a"), F.col("b")]).select("a", "b", "pair_id")


def advert_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "clean_khmer24")
    return evidence.cohorts(rows, {"no_price": F.col("price_usd").isNull(), "no_size": F.col("size_m2").isNull(), "cheap": F.col("price_usd") < 30000, "high_floor": F.col("unit_floor") > 30, "above_roof": F.col("unit_floor") > F.col("building_total_floors")})


def district_triage(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.triage(table(spark, sf, "clean_khmer24"), "project_name", "district")


def advert_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = evidence.violations(table(spark, sf, "clean_harbor"), "listing_id", ["title", "price_usd"], ["size_m2"], {"listing_type": ["sale", "sale/rent"]})
    return found.groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (first_adverts, repeated_coordinates, folded_adverts, all_adverts, kept_and_removed, coverage_gaps, merged_customers, latest_events, filled_names, blocked_pairs, scored_pairs, judged_pairs, pair_sources, band_duplicates, signature_groups, applied_corrections, manual_queue, numbered_pairs, advert_cohorts, district_triage, advert_violations)}

_ONE = "SELECT * FROM (SELECT listing_id, title, {cols}, '{t}' AS source, row_number() OVER (PARTITION BY listing_id ORDER BY title NULLS FIRST, price_usd NULLS FIRST) AS rn FROM {t} WHERE title IS NOT NULL) WHERE rn = 1"
_COLS = "property_type, district, bedrooms, size_m2, price_usd"
_BANDS = "WITH r AS (SELECT * FROM (SELECT listing_id, district, bedrooms, size_m2, price_usd, row_number() OVER (PARTITION BY listing_id ORDER BY price_usd NULLS FIRST, size_m2 NULLS FIRST) AS rn FROM clean_harbor) WHERE rn = 1 AND price_usd > 0), p AS (SELECT x.listing_id AS a, y.listing_id AS b FROM r x JOIN r y ON x.district = y.district AND x.bedrooms = y.bedrooms WHERE x.listing_id < y.listing_id AND abs(x.size_m2 - y.size_m2) <= 2.0 AND abs(x.price_usd - y.price_usd) <= 0.03 * greatest(x.price_usd, y.price_usd)) "
_COHORTS = {"no_price": "price_usd IS NULL", "no_size": "size_m2 IS NULL", "cheap": "price_usd < 30000", "high_floor": "unit_floor > 30", "above_roof": "unit_floor > building_total_floors"}
ORACLE = {
    "first_adverts": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1",
    "repeated_coordinates": "SELECT coord_id, latitude IS NOT NULL AND longitude IS NOT NULL AND count(*) OVER (PARTITION BY latitude, longitude) > 1 AS is_repeated FROM validated_project_coordinates",
    "all_adverts": "SELECT record_status, count(*) AS n, count(DISTINCT listing_id) AS ids FROM (SELECT record_status, listing_id FROM clean_khmer24 UNION ALL SELECT record_status, listing_id FROM clean_harbor) GROUP BY 1",
    "kept_and_removed": "SELECT CASE WHEN project_name IN (SELECT project_name FROM clean_khmer24 WHERE project_name IS NOT NULL) THEN 'removed' ELSE 'kept' END AS side, count(*) AS n, count(DISTINCT listing_id) AS ids FROM clean_harbor GROUP BY 1",
    "coverage_gaps": "SELECT problem, count(*) AS n FROM (SELECT 'only_left' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'only_right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey) GROUP BY 1",
    "merged_customers": "WITH b AS (SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_name END AS n, c_acctbal AS a FROM customer), u AS (SELECT c_custkey, upper(c_name) AS n2, CASE WHEN c_acctbal > 0 THEN c_acctbal + 1 END AS a2 FROM customer WHERE c_nationkey < 10) SELECT c_custkey, coalesce(n, n2) AS c_name, round(coalesce(a2, a), 2) AS c_acctbal FROM b FULL JOIN u USING (c_custkey)",
    "latest_events": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1",
    "filled_names": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'nation' ELSE 'original' END AS c_mktsegment_source FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "blocked_pairs": f"WITH r AS ({_ONE.format(t='clean_khmer24', cols=_COLS)} UNION ALL {_ONE.format(t='clean_harbor', cols=_COLS)}), k AS (SELECT listing_id, source, property_type, district, bedrooms, unnest([round_even(size_m2 / 5.0, 0) - 1, round_even(size_m2 / 5.0, 0), round_even(size_m2 / 5.0, 0) + 1]) AS band FROM r WHERE property_type IS NOT NULL AND district IS NOT NULL AND bedrooms IS NOT NULL AND size_m2 IS NOT NULL) SELECT DISTINCT x.listing_id AS a, y.listing_id AS b FROM k x JOIN k y USING (property_type, district, bedrooms, band) WHERE x.listing_id < y.listing_id AND x.source <> y.source",
    "pair_sources": "SELECT concat(least(x.n_name, y.n_name), ' <-> ', greatest(x.n_name, y.n_name)) AS pair, count(*) AS n FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_name <> y.n_name GROUP BY 1",
    "band_duplicates": _BANDS + "SELECT a, b FROM p",
    "numbered_pairs": _BANDS + "SELECT a, b, printf('pair_%05d', row_number() OVER (ORDER BY a, b)) AS pair_id FROM p",
    "advert_cohorts": " UNION ALL ".join(f"SELECT '{n}' AS cohort, count(*) FILTER (WHERE {c}) AS n FROM clean_khmer24" for n, c in _COHORTS.items()),
    "district_triage": "WITH k AS (SELECT project_name, count(DISTINCT district) AS d FROM clean_khmer24 WHERE district IS NOT NULL AND project_name IS NOT NULL GROUP BY 1) SELECT CASE WHEN d = 1 THEN 'resolvable' WHEN d > 1 THEN 'ambiguous' ELSE 'unmapped' END AS verdict, count(*) AS n FROM clean_khmer24 LEFT JOIN k USING (project_name) WHERE district IS NULL GROUP BY 1",
    "advert_violations": "SELECT problem, count(*) AS n FROM (SELECT 'missing_title' AS problem FROM clean_harbor WHERE title IS NULL OR trim(title) = '' UNION ALL SELECT 'missing_price_usd' FROM clean_harbor WHERE price_usd IS NULL UNION ALL SELECT 'not_positive_size_m2' FROM clean_harbor WHERE size_m2 <= 0 UNION ALL SELECT 'unknown_listing_type' FROM clean_harbor WHERE listing_type NOT IN ('sale', 'sale/rent') UNION ALL SELECT 'repeated' FROM clean_harbor GROUP BY listing_id HAVING count(*) > 1) GROUP BY 1",
    "signature_groups": "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM clean_khmer24 WHERE title IS NOT NULL AND price_usd IS NOT NULL AND size_m2 IS NOT NULL GROUP BY title, price_usd, size_m2, bedrooms, district) GROUP BY 1",
    "applied_corrections": "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 14 = 0 THEN 9 ELSE s_nationkey END AS INTEGER) AS s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN 12.5 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 7 = 0 THEN concat('s_acctbal: ', CAST(s_acctbal AS VARCHAR), ' -> 12.5', CASE WHEN s_suppkey % 14 = 0 THEN concat('; s_nationkey: ', CAST(s_nationkey AS VARCHAR), ' -> 9') ELSE '' END) ELSE '' END AS notes FROM supplier",
    "manual_queue": "SELECT listing_id, title, review_reason, CAST(NULL AS VARCHAR) AS manual_decision FROM clean_harbor WHERE record_status = 'review'",
}
