import pytest
from pyspark.sql import functions as F

from lakemason.functions import extract as X
from lakemason.functions import numeric as N
from lakemason.functions import text as T


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (T.clean_text, " a\u00a0b\u200b\n", "a b"), (T.clean_text, "   ", None), (T.clean_text, None, None),
        (T.normalize_url, "HTTPS://Example.com/Property/1/?utm_source=x#top", "https://example.com/Property/1"), (T.normalize_url, None, None),
        (T.listing_type, "For Sale or Rent", "sale/rent"), (T.listing_type, "Lease", "rent"), (T.listing_type, "Buy now", "sale"), (T.listing_type, "Auction", "auction"),
        (T.type_label, "condominium", "Condo"), (T.type_label, "2br-unit", "2Br-Unit"),
        (T.path_shape, "https://x.y/property/luxury-condo-bkk1/", "/property/luxury-condo-bkk1"), (T.path_shape, "https://x.y/en/listing/123/", "/en/listing/*"), (T.path_shape, "https://x.y/", "/"), (T.path_shape, "https://x.y/a/b/c", "/a/b/*"),
        (T.title_key, "TIME SQUARE 5 | 2BR Condo Sale", "time square"), (T.title_key, "Le Condé BKK1 – 3 Bedrooms", "le conde bkk1"), (T.title_key, None, ""),
        (T.title_key, "2 Bedroom Condo for Sale in Time Square 5 – 65sqm, 12th floor, $95,000", "in time square 95 000"),
        (lambda c: T.strip_suffixes(c, T.AGE_ENDINGS), "Nice condo 21h •", "Nice condo"), (lambda c: T.strip_suffixes(c, T.AGE_ENDINGS), "Nice condo Jun 14 •", "Nice condo"),
        (T.collapse_repeat, "Nice condo sale 12 Nice condo sale Phnom Penh", "Nice condo sale"), (lambda c: T.excerpt(c, 4), "abcd efg", "abcd..."), (lambda c: T.excerpt(c, 40), "abcd efg", "abcd efg"),
        (lambda c: T.group_id(c, "realestate", "listing_id"), "123", "realestate_listing_id_40bd00156308"), (T.letter_code, " ab12345 ", "AB12345"), (T.letter_code, "abcd12345", None),
        (lambda c: T.location_parts(c)["district"], "No. 1, Tonle Kesor, Phnom Penh", "Tonle Kesor"), (lambda c: T.location_parts(c)["district"], "Phnom Penh", None),
        (lambda c: T.resolve_place(c, {"Toul Kork": "Toul Kork", "tuol kouk": "Toul Kork"}, {"chak angrae leu": "Meanchey"}), "tuol-kouk", "Toul Kork"),
        (lambda c: T.resolve_place(c, {"Toul Kork": "Toul Kork"}, {"chak angrae leu": "Meanchey"}), "near Chak Angrae Leu market", "Meanchey"), (lambda c: T.prefixed_id(c, "k_"), "k_1", "k_1"), (lambda c: T.prefixed_id(c, "k_"), "1", "k_1"),
        (X.safe_float, "$95,000 USD", 95000.0), (X.safe_float, "abc", None), (X.safe_int, "2.0", 2), (X.safe_int, "2.5", None),
        (X.amount, "$85,000", 85000.0), (X.amount, "85K", 85000.0), (X.amount, "Negotiable", None), (lambda c: X.amount(c, 1000, 50e6), "500", None), (lambda c: X.amount(c, 1000, 50e6), "1.2M", 1200000.0),
        (X.size_m2, "65 sqm", 65.0), (X.size_m2, "700 sqft", 65.03), (lambda c: X.bedrooms(c)["value"], "Studio near river", 0), (lambda c: X.bedrooms(c)["value"], "nice 2BR, 3 bath", 2), (lambda c: X.bedrooms(c)["value"], "99 bedrooms, bedrooms: 4", 4),
        (lambda c: X.bedrooms(c)["value"], "មាន ២ បន្ទប់គេង", 2), (lambda c: X.unit_floor(c)["value"], "located on the 15th floor", 15), (lambda c: X.unit_floor(c)["value"], "30-storey building", None), (lambda c: X.unit_floor(c)["value"], "ជាន់ទី 15", 15),
        (lambda c: X.total_floors(c)["value"], "a 30-storey building", 30), (X.title_bedrooms, "3+1 Bedroom", 4), (lambda c: X.title_bedrooms(c, "first"), "3+1 Bedroom", 3), (X.title_bedrooms, "two bedroom", 2), (X.title_bedrooms, "Studio", 0), (X.title_bedrooms, "2BR", 2),
        (X.bedroom_options, "1 & 2 bedrooms", [1, 2]), (X.bedroom_options, "2 bedrooms", None), (lambda c: X.rooms_not_after(c, r"(\d{1,2})\s*bed", "floor"), "floor 9 bed, later 2 bed", 2), (X.transaction_type, "8% rental yield condo for sale", "sale"),
        (lambda c: X.marked_amounts(c), "$5, USD 95,000 or $120,000", [95000.0, 120000.0]), (lambda c: X.near_label(c, "size|面积"), "Size: about 66.5 sqm", 66.5), (lambda c: X.agreed_label(c, {"bkk1": "A", "tk": "B"}), "in bkk1", "A"), (lambda c: X.agreed_label(c, {"bkk1": "A", "tk": "B"}), "bkk1 or tk", None),
        (T.short_usd, "1240", "$1.2K"),
    ],
)
def test_values(one, function, given, wanted):
    c = F.col("c")
    expr = function(c.cast("double")) if function is T.short_usd else function(c)
    assert one(given, v=expr)["v"] == wanted


def test_ordered_reasons_and_labels(one):
    got = one("Condo penthouse", r=T.ordered_reasons(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")), none=T.ordered_reasons(F.lit(None).cast("string")), k=T.all_labels(F.col("c"), [("condo", "Condo"), ("penthouse", "Penthouse")]))
    assert got == {"r": "b; a", "none": None, "k": ["Condo", "Penthouse"]}


@pytest.mark.parametrize(("a", "b", "wanted"), [(100000.0, 103000.0, True), (100000.0, 103100.0, False), (20000.0, 20900.0, True), (None, 1.0, False)])
def test_is_close(spark, a, b, wanted):
    assert spark.range(1).select(N.is_close(F.lit(a).cast("double"), F.lit(b), 0.03, 1000.0)).first()[0] is wanted


def test_bands(spark):
    rows = spark.createDataFrame([(57.5,), (62.5,), (-1.0,), (None,)], "v double").select("v", N.half_even_band(F.col("v"), 5.0).alias("b"), N.cut(F.col("v"), [0, 57.5, 100], ["low", "high"]).alias("c")).collect()
    assert [(r["b"], r["c"]) for r in rows] == [(12, "low"), (12, "high"), (0, None), (None, None)]
    assert spark.range(1).select(N.ratio(F.lit(0.0), F.lit(2.0)), N.discount_percent(F.lit(100.0), F.lit(75.0)), N.in_box(F.lit(11.57), F.lit(104.9), 11.3, 11.8, 104.7, 105.1)).first()[:] == (None, 25.0, True)
