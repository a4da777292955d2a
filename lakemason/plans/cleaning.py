"""Cleaning queries: text, labels, numbers and fields out of free text, rules and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemason.functions import extract as X
from lakemason.functions import html as H
from lakemason.functions import numeric as N
from lakemason.functions import text as T
from lakemason.operators import location, resolve, rules
from lakemason.operators.joins import fill_from_map
from lakemason.sources.tables import table


def _adverts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clean_khmer24")


def _each(spark: SparkSession, sf: str, **made: Column) -> DataFrame:
    return _adverts(spark, sf).select("listing_id", *[c.alias(n) for n, c in made.items()])


def clean_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, title=T.clean_text(F.col("title")), description=T.clean_text(F.col("description")))


def normalized_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, url=T.normalize_url(F.col("url")), slug=T.slug(F.col("url")))


def url_shapes(spark: SparkSession, sf: str) -> DataFrame:
    shapes = table(spark, sf, "documents").where("url is not null").groupBy(T.path_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))
    return shapes.orderBy(F.desc("n"), "shape").limit(50)


def url_hints(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return _adverts(spark, sf).agg(F.count_if(T.has_hint(u, ["/adid-", "property"])).alias("listing"), F.count_if(u.rlike(r"#|\?")).alias("with_fragment"), F.count_if(F.length(u) - F.length(F.regexp_replace(u, "-", "")) >= 1).alias("dashed"), F.count("url").alias("n"))


def listing_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _adverts(spark, sf).groupBy(T.listing_type(F.col("listing_type")).alias("listing_type"), T.type_label(F.col("property_type_original")).alias("property_type")).agg(F.count("*").alias("n"))


def recognised_types(spark: SparkSession, sf: str) -> DataFrame:
    kind = T.first_label(F.col("title"), [("penthouse", "Penthouse"), ("studio", "Studio"), ("villa|townhouse", "House"), ("condo", "Condo")], F.lit("unknown"))
    return _adverts(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    found = T.all_labels(F.col("title"), [("penthouse", "Penthouse"), ("studio", "Studio"), ("condo", "Condo"), ("residence", "Residence")])
    return _each(spark, sf, kinds=F.array_join(found, ","), status=T.match_status(found))


def price_texts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("price_original")
    return _each(spark, sf, number=X.safe_float(p), whole=X.safe_int(p), amount=X.amount(p))


def title_sizes(spark: SparkSession, sf: str) -> DataFrame:
    found = T.matched(F.lower(F.col("title")), r"([0-9]+(?:\.[0-9]+)?) ?(?:sqm|m2|sqft)", 0)
    return _each(spark, sf, size=X.size_m2(found), near=X.first_int(found))


def title_rooms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    return _each(spark, sf, rooms=X.bedrooms(t)["value"], summed=X.title_bedrooms(t), main=X.title_bedrooms(t, "first"), extra=X.extra_rooms(t)["extra"])


def text_floors(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("description")
    return _each(spark, sf, floor=X.unit_floor(t)["value"], total=X.total_floors(t)["value"], baths=X.bathrooms(t)["value"])


def marked_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, highest=F.array_max(X.marked_amounts(F.col("title"))), n=F.size(X.marked_amounts(F.col("title"))))


def level_last(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, level=T.last_match(F.col("description"), [r"level ([0-9]+)", r"floor ([0-9]+)"]).try_cast("int"))


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clean_harbor").select("listing_id", T.signature_text(F.col("address")).alias("signature"), T.name_key(F.col("address")).alias("key"))


def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clean_harbor").select("listing_id", T.title_key(F.col("title")).alias("title_key"))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"), F.length("text").cast("long").alias("n"))


def group_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, group_id=T.group_id(F.col("listing_id"), "realestate", "listing_id"), global_id=T.prefixed_id(F.col("source_listing_id"), "k24_"))


def codes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("source_listing_code")
    return table(spark, sf, "clean_harbor").select("listing_id", T.digits_code(c).alias("digits"), T.letter_code(c).alias("code"), T.chosen_code(T.digits_code(F.col("url")), T.digits_code(c))["value"].alias("chosen"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(", ", "address", "district", "city")
    return _each(spark, sf, district=T.location_parts(text)["district"], commune=T.location_parts(text)["commune"])


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return _adverts(spark, sf).groupBy(X.transaction_type(F.col("title")).alias("offer")).agg(F.count("*").alias("n"))


def district_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Districts by exact alias only, others passed through."""
    mapping = table(spark, sf, "district_mapping").select(F.col("raw_name").alias("district"), F.col("standard_name").alias("standard"))
    rows = _adverts(spark, sf).select("district").join(mapping, "district", "left")
    return rows.groupBy(F.coalesce("standard", "district").alias("district")).agg(F.count("*").alias("n"))


def unit_price_check(spark: SparkSession, sf: str) -> DataFrame:
    again = N.ratio(F.col("price_usd"), F.col("size_m2"))
    off = F.abs(F.col("price_per_m2") - again)
    return _adverts(spark, sf).agg(F.count(off).alias("n"), F.count_if(off > 0.011).alias("off"), F.count_if(again.isNotNull() & F.col("price_per_m2").isNull()).alias("absent"))


def line_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule engine over lines: rejects, reviews and their reasons."""
    q, d, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    out = rules.classify(table(spark, sf, "lineitem"), [rules.Rule("returned", "reject", F.col("l_returnflag") == "R"), rules.Rule("tiny", "reject", q < 2), rules.Rule("deep_discount", "review", d > 0.08), rules.Rule("dear_unit", "review", N.ratio(p, q) > 2000), rules.Rule("big", "review", q > 45)])
    return out.groupBy("record_status", F.array_join("reject_reasons", "; ").alias("rejects"), F.array_join("review_reasons", "; ").alias("reviews")).agg(F.count("*").alias("n"))


def rule_reasons(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    out = rules.classify(table(spark, sf, "lineitem"), [rules.Rule("returned", "reject", F.col("l_returnflag") == "R"), rules.Rule("tiny", "reject", q < 2), rules.Rule("big", "review", q > 45)])
    return rules.reason_counts(out, "reject_reasons", "review_reasons")


def recovered_rooms(spark: SparkSession, sf: str) -> DataFrame:
    rows = _adverts(spark, sf).select("bedrooms", X.bedrooms(F.col("title")).alias("t"), X.bedrooms(F.col("description")).alias("d"))
    rows, r = rows.select(resolve.recover(F.col("bedrooms"), F.col("t"), F.col("d")).alias("r")), F.col("r")
    return rows.groupBy(r["source"].alias("source"), r["confidence"].alias("confidence"), r["conflict"].isNotNull().alias("conflicting")).agg(F.count("*").alias("n"), F.sum(r["value"]).alias("rooms"))


def resolved_floor(spark: SparkSession, sf: str) -> DataFrame:
    """A floor from field (80), title (30) and description (20): the highest priority wins."""
    level = lambda c, p: T.matched(F.lower(F.col(c)), p, 1)
    cands = F.array(resolve.candidate(level("description", r"level ([0-9]+)"), "description", 20), resolve.candidate(level("title", r"floor ([0-9]+)"), "title", 30), resolve.candidate(F.col("unit_floor"), "field", 80))
    r = resolve.resolve(cands, valid=lambda v: v.try_cast("int").between(1, 100))
    return _adverts(spark, sf).select("listing_id", r["value"].try_cast("int").alias("floor"), r["source"].alias("source"), F.size(r["conflicts"]).alias("n_conflicts"))


def recovered_districts(spark: SparkSession, sf: str) -> DataFrame:
    """Waterfall: from the location text, then from projects that determine their district."""
    rows = _adverts(spark, sf).select("listing_id", "district", "location_text", "project_name")
    from_text = F.nullif(F.trim(F.regexp_extract("location_text", r"^([^,]+),", 1)), F.lit(""))
    out = location.waterfall(rows, "district", [("location_text", from_text), ("project", location.learned_fill("project_name", "district", 3))])
    return out.groupBy("district_source").agg(F.count("*").alias("n"), F.count_distinct("district").alias("districts"))


def geocode_levels(spark: SparkSession, sf: str) -> DataFrame:
    level = location.geocode_level([("project", F.col("project_name").isNotNull()), ("address", F.col("address").isNotNull()), ("location_text", F.col("location_text").isNotNull()), ("district_only", F.col("district").isNotNull())])
    return _adverts(spark, sf).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def coordinate_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = location.check_coordinates(table(spark, sf, "validated_project_coordinates"), "latitude", "longitude", (11.3, 11.8, 104.7, 105.1))
    return rows.select("coord_id", "coordinate_check")


def project_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Adverts with the coordinates of their project where it has one record only."""
    coords = table(spark, sf, "validated_project_coordinates").dropna(subset=["latitude", "project_name"]).groupBy("project_name").agg(F.min("latitude").alias("latitude"), F.max("latitude").alias("_hi"))
    one = coords.where("latitude = _hi").drop("_hi")
    filled = fill_from_map(_adverts(spark, sf).select("listing_id", "project_name", "latitude"), "project_name", "latitude", one, source="project")
    return filled.groupBy("latitude_source").agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 4).alias("mean_latitude"))


def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Pages built from adverts, taken apart again: title, label pairs and links."""
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), F.translate("title", "<>&", "   "), F.lit("</h1><dl><dt>Rooms</dt><dd>"), F.coalesce(F.col("bedrooms").cast("string"), F.lit("-")), F.lit("</dd></dl><a href='/a/"), F.col("listing_id"), F.lit("'>more</a></body></html>"))
    rows = _adverts(spark, sf).select("listing_id", page.alias("html"))
    return rows.select("listing_id", H.title_column(F.col("html")).alias("title"), F.get(H.pairs_column(F.col("html")), F.lit(0))["value"].alias("rooms"), F.array_join(H.links(F.col("html"), "https://k24.example"), ",").alias("links"))


def stated_places(spark: SparkSession, sf: str) -> DataFrame:
    """Districts named in a strong phrase of the description."""
    places = {"toul vihear thmey": "Toul Vihear Thmey", "chamkar rumdoul": "Chamkar Rumdoul", "boeung sorya [123]": "Boeung Sorya"}
    found = T.all_labels(F.coalesce("title", F.lit("")), T.phrase_rules(places, ["sale {}", "view {}", "- {}", "{} .{0,20}urgent"]))
    return _adverts(spark, sf).groupBy(T.match_status(found).alias("status"), F.array_join(found, ",").alias("found")).agg(F.count("*").alias("n"))


QUERIES = {
    q.__name__: q
    for q in (
        clean_titles, normalized_urls, url_shapes, url_hints, listing_labels, recognised_types, all_kinds, price_texts, title_sizes, title_rooms, text_floors, marked_amounts, level_last, signatures, title_keys, excerpts, group_ids,
        codes, places, transactions, district_labels, unit_price_check, line_rules, rule_reasons, recovered_rooms, resolved_floor, recovered_districts, geocode_levels, coordinate_checks, project_coordinates, html_fields, stated_places,
    )
}

_ZW = "chr(8203), ''), chr(65279), '')"
_CLEAN = "nullif(trim(regexp_replace(replace(replace(replace({0}, chr(160), ' '), " + _ZW + ", '[\\s\\x{{0085}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' '), '')"
_FIRST = "nullif(regexp_extract({0}, '{1}', {2}), '')"
_RATIO = "CASE WHEN {0} > 0 AND {1} > 0 THEN round({0} / {1}, 2) END"
_REJ = "concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_quantity < 2 THEN 'tiny' END)"
_REV = "concat_ws('; ', CASE WHEN l_discount > 0.08 THEN 'deep_discount' END, CASE WHEN round(l_extendedprice / l_quantity, 2) > 2000 THEN 'dear_unit' END, CASE WHEN l_quantity > 45 THEN 'big' END)"
_KIND = "concat_ws(',', CASE WHEN title ILIKE '%condo%' THEN 'Condo' END, CASE WHEN title ILIKE '%penthouse%' THEN 'Penthouse' END, CASE WHEN title ILIKE '%residence%' THEN 'Residence' END, CASE WHEN title ILIKE '%studio%' THEN 'Studio' END)"
_LEVEL = "try_cast(nullif(regexp_extract(lower({0}), '{1} ([0-9]+)', 1), '') AS INTEGER)"
_PARTS = "list_filter(list_transform(string_split(replace(replace(concat_ws(', ', address, district, city), chr(8203), ''), chr(65279), ''), ','), lambda x: trim(regexp_replace(x, '[\\s\\x{00A0}]+', ' ', 'g'))), lambda x: x <> '')"
_SEGMENT = "({0} IS NOT NULL AND NOT regexp_matches({0}, '[0-9]{{3,}}') AND length({0}) < 20)"
_S1, _S2 = _SEGMENT.format("a"), _SEGMENT.format("b")
_STATED = "concat_ws(','" + "".join(f", CASE WHEN regexp_matches(coalesce(lower(title), ''), '" + "|".join(t.replace("{}", f"(?:{p})") for t in ("sale {}", "view {}", "- {}", "{} .{0,20}urgent")).replace("'", "''") + f"') THEN '{n}' END" for p, n in (("boeung sorya [123]", "Boeung Sorya"), ("chamkar rumdoul", "Chamkar Rumdoul"), ("toul vihear thmey", "Toul Vihear Thmey"))) + ")"
_CLEAN = r"nullif(trim(regexp_replace(translate({0}, chr(160) || chr(8203) || chr(65279), '   '), '[\s\x{{0085}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\v]+', ' ', 'g')), '')"
_END = "(?:[^A-Za-z0-9_]|$)"
_START = "(?:^|[^A-Za-z0-9_])"


def _first(text: str, patterns: list[str], low: int, high: int) -> str:
    """The first pattern's number in range, with word edges as SQL's patterns can tell them."""
    plain = lambda p: p.replace(T.LEFT, _START).replace(T.RIGHT, _END).replace(r"(?<!\d)", "(?:^|[^0-9])").replace("'", "''")
    value = lambda p: f"try_cast(nullif(regexp_extract({text}, '(?i){plain(p)}', 1), '') AS INTEGER)"
    return "coalesce(" + ", ".join(f"CASE WHEN {value(p)} BETWEEN {low} AND {high} THEN {value(p)} END" for p in patterns) + ")"


def _rooms(text: str) -> str:
    return f"coalesce({_first(text, X.BEDROOMS, 0, 15)}, CASE WHEN regexp_matches({text}, '(?i){_START}studio{_END}') THEN 0 END)"


_DIGITS = "translate(" + _CLEAN + ", '០១២៣៤៥៦៧៨៩', '0123456789')"
_PLUS = r"try_cast(nullif(regexp_extract(t, '(?i)(\d{{1,2}})\s*\+\s*(\d{{1,2}})\s*-?\s*(?:bed|br)', {0}), '') AS INTEGER)"
_COUNTED = "coalesce(CASE WHEN regexp_matches(t, '(?i)" + _START + "studio" + _END + r"') THEN 0 END, try_cast(nullif(regexp_extract(t, '(?i)(?:^|[^0-9+])(\d{1,2})\s*-?\s*(?:bed|br)', 1), '') AS INTEGER), CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){_START}{w}[\\s-]+bed') THEN {n}" for w, n in X.NUMBER_WORDS.items()) + " END)"
_RECOVERED = "WITH r AS (SELECT bedrooms AS b, " + _rooms(_DIGITS.format("title")) + " AS t, " + _rooms(_DIGITS.format("description")) + " AS d FROM clean_khmer24) SELECT CASE WHEN b IS NOT NULL THEN 'structured' WHEN t IS NOT NULL THEN 'title' WHEN d IS NOT NULL THEN 'description' END AS source, CASE WHEN b IS NULL AND t IS NOT NULL THEN 'high' WHEN b IS NULL AND d IS NOT NULL THEN 'medium' END AS confidence, coalesce(t <> b, FALSE) OR coalesce(d <> b, FALSE) AS conflicting, count(*) AS n, sum(coalesce(b, t, d)) AS rooms FROM r GROUP BY 1, 2, 3"
_TITLE_KEY = r"translate(lower(" + _CLEAN.format("title") + r"), 'éèê–—-_', 'eee    ')"
for _pattern, _with in ((r"\b(?:usd|us\$|\$)\s*[\d,.]+\b", " "), (r"\b\d+(?:\.\d+)?\s*(?:sqm|sq\.?\s*m|m2|m²)([^a-z0-9_]|$)", r" \1"), (r"\b\d+(?:st|nd|rd|th)?\s+floor\b", " "), (r"\b\d+\s*(?:bed|beds|bedroom|bedrooms|br)\b", " ")):
    _TITLE_KEY = f"regexp_replace({_TITLE_KEY}, '{_pattern}', '{_with}', 'g')"
_LABEL = "lower(" + _CLEAN.format("listing_type") + ")"
_TYPED = _CLEAN.format("property_type_original")
_SALE, _RENT = (f"regexp_matches(l, '{_START}(?:{w}){_END}')" for w in ("sale|sell|buy", "rent|rental|lease"))
_listed = lambda values: ", ".join(f"'{v}'" for v in values)
_LABELS = (
    f"WITH r AS (SELECT {_LABEL} AS l, {_TYPED} AS p FROM clean_khmer24) SELECT CASE WHEN l IN ({_listed(T.BOTH_LABELS)}) THEN 'sale/rent' WHEN l IN ({_listed(T.SALE_LABELS)}) THEN 'sale' WHEN l IN ({_listed(T.RENT_LABELS)}) THEN 'rent' "
    f"WHEN {_SALE} AND {_RENT} THEN 'sale/rent' WHEN {_SALE} THEN 'sale' WHEN {_RENT} THEN 'rent' ELSE l END AS listing_type, CASE lower(p) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TYPE_LABELS.items())
    + r" ELSE array_to_string(list_transform(regexp_extract_all(p, '\p{L}+|[^\p{L}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') END AS property_type, count(*) AS n FROM r GROUP BY 1, 2"
)

ORACLE = {
    "stated_places": f"SELECT CASE WHEN f = '' THEN 'none' WHEN contains(f, ',') THEN 'ambiguous' ELSE 'single' END AS status, f AS found, count(*) AS n FROM (SELECT {_STATED} AS f FROM clean_khmer24) GROUP BY ALL",
    "places": f"SELECT listing_id, CASE WHEN len(p) >= 2 THEN p[-2] END AS district, CASE WHEN len(p) >= 3 THEN p[-3] END AS commune FROM (SELECT listing_id, {_PARTS} AS p FROM clean_khmer24)",
    "url_shapes": f"SELECT CASE WHEN path = '' THEN '/' WHEN NOT {_S1} THEN '/*' WHEN b IS NULL THEN concat('/', a) WHEN NOT {_S2} THEN concat('/', a, '/*') WHEN n > 2 THEN concat('/', a, '/', b, '/*') ELSE concat('/', a, '/', b) END AS shape, count(*) AS n FROM (SELECT path, string_split(path, '/')[1] AS a, string_split(path, '/')[2] AS b, len(string_split(path, '/')) AS n FROM (SELECT trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/') AS path FROM documents WHERE url IS NOT NULL)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "html_fields": "SELECT listing_id, nullif(trim(regexp_replace(translate(title, '<>&', '   '), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), '') AS title, coalesce(CAST(bedrooms AS VARCHAR), '-') AS rooms, concat('https://k24.example/a/', listing_id) AS links FROM clean_khmer24",
    "clean_titles": f"SELECT listing_id, {_CLEAN.format('title')} AS title, {_CLEAN.format('description')} AS description FROM clean_khmer24",
    "normalized_urls": "SELECT listing_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url, nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]+)$', 1), '') AS slug FROM clean_khmer24",
    "url_hints": "SELECT count(*) FILTER (WHERE contains(lower(url), '/adid-') OR contains(lower(url), 'property')) AS listing, count(*) FILTER (WHERE regexp_matches(url, '#|\\?')) AS with_fragment, count(*) FILTER (WHERE contains(url, '-')) AS dashed, count(url) AS n FROM clean_khmer24",
    "recognised_types": "SELECT CASE WHEN title ILIKE '%penthouse%' THEN 'Penthouse' WHEN title ILIKE '%studio%' THEN 'Studio' WHEN title ILIKE '%villa%' OR title ILIKE '%townhouse%' THEN 'House' WHEN title ILIKE '%condo%' THEN 'Condo' ELSE 'unknown' END AS kind, count(*) AS n FROM clean_khmer24 GROUP BY 1",
    "all_kinds": f"SELECT listing_id, coalesce({_KIND}, '') AS kinds, CASE WHEN {_KIND} = '' THEN 'none' WHEN contains({_KIND}, ',') THEN 'ambiguous' ELSE 'single' END AS status FROM clean_khmer24 WHERE title IS NOT NULL UNION ALL SELECT listing_id, '', 'none' FROM clean_khmer24 WHERE title IS NULL",
    "price_texts": "SELECT listing_id, x AS number, CASE WHEN x = floor(x) THEN CAST(x AS INTEGER) END AS whole, CASE WHEN NOT regexp_matches(upper(price_original), 'NEGOTIABLE|POA|ON REQUEST|CONTACT') AND floor(y) > 0 THEN floor(y) END AS amount FROM (SELECT *, try_cast(nullif(regexp_extract(regexp_replace(trim(price_original), '\\$|,|USD|usd', '', 'g'), '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS x, try_cast(replace(nullif(regexp_extract(price_original, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), ''), ',', '') AS DOUBLE) * CASE upper(regexp_extract(price_original, '\\d[\\d,]*(?:\\.\\d+)?\\s*([KkMm])', 1)) WHEN 'K' THEN 1000.0 WHEN 'M' THEN 1000000.0 ELSE 1.0 END AS y FROM clean_khmer24)",
    "title_sizes": "SELECT listing_id, CASE WHEN s > 0 THEN s END AS size, try_cast(nullif(regexp_extract(f, '\\d+'), '') AS INTEGER) AS near FROM (SELECT listing_id, f, round(CASE WHEN contains(f, 'ft') THEN try_cast(regexp_extract(f, '[0-9]+(?:\\.[0-9]+)?') AS DOUBLE) * 0.092903 ELSE try_cast(regexp_extract(f, '[0-9]+(?:\\.[0-9]+)?') AS DOUBLE) END, 2) AS s FROM (SELECT listing_id, nullif(regexp_extract(lower(title), '([0-9]+(?:\\.[0-9]+)?) ?(?:sqm|m2|sqft)', 0), '') AS f FROM clean_khmer24))",
    "marked_amounts": "SELECT listing_id, list_max(v) AS highest, CAST(len(v) AS INTEGER) AS n FROM (SELECT listing_id, list_filter(list_transform(regexp_extract_all(title, '(?i)(?:\\$|usd)\\s*(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x BETWEEN 10000 AND 20000000) AS v FROM clean_khmer24)",
    "level_last": "SELECT listing_id, CASE WHEN len(a) > 0 THEN try_cast(a[-1] AS INTEGER) WHEN len(b) > 0 THEN try_cast(b[-1] AS INTEGER) END AS level FROM (SELECT listing_id, regexp_extract_all(description, 'level ([0-9]+)', 1) AS a, regexp_extract_all(description, 'floor ([0-9]+)', 1) AS b FROM clean_khmer24)",
    "signatures": "SELECT listing_id, nullif(trim(regexp_replace(lower(address), '[^\\p{L}\\p{M}\\p{N}_\\x{1780}-\\x{17ff}]+', ' ', 'g')), '') AS signature, coalesce(trim(regexp_replace(lower(address), '[^a-z0-9]+', ' ', 'g')), '') AS key FROM clean_harbor",
    "excerpts": "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(rtrim(left(text, 200), ' '), '...') ELSE text END AS excerpt, CAST(length(text) AS BIGINT) AS n FROM documents",
    "group_ids": "SELECT listing_id, concat('realestate_listing_id_', left(sha1(listing_id), 12)) AS group_id, CASE WHEN starts_with(source_listing_id, 'k24_') THEN source_listing_id WHEN source_listing_id IS NULL THEN NULL ELSE concat('k24_', source_listing_id) END AS global_id FROM clean_khmer24",
    "codes": "SELECT listing_id, d AS digits, CASE WHEN regexp_full_match(upper(trim(source_listing_code)), '[A-Z]{1,3}[0-9]{5,}') THEN upper(trim(source_listing_code)) END AS code, coalesce(nullif(regexp_replace(url, '[^0-9]', '', 'g'), ''), d) AS chosen FROM (SELECT *, nullif(regexp_replace(source_listing_code, '[^0-9]', '', 'g'), '') AS d FROM clean_harbor)",
    "transactions": "SELECT CASE WHEN s AND r THEN 'sale/rent' WHEN s THEN 'sale' WHEN r THEN 'rent' END AS offer, count(*) AS n FROM (SELECT regexp_matches(t, '\\b(?:sale|sell|buy)\\b') AS s, regexp_matches(t, '\\b(?:rent|rental|lease)\\b') AS r FROM (SELECT regexp_replace(lower(title), '(?:guaranteed\\s+)?rent(?:al)?\\s+(?:yield|return|income|guarantee)s?', ' ', 'g') AS t FROM clean_khmer24)) GROUP BY 1",
    "district_labels": "SELECT coalesce(standard_name, district) AS district, count(*) AS n FROM clean_khmer24 LEFT JOIN district_mapping ON raw_name = district GROUP BY 1",
    "unit_price_check": f"SELECT count(o) AS n, count(*) FILTER (WHERE o > 0.011) AS off, count(*) FILTER (WHERE a IS NOT NULL AND price_per_m2 IS NULL) AS absent FROM (SELECT price_per_m2, {_RATIO.format('price_usd', 'size_m2')} AS a, abs(price_per_m2 - {_RATIO.format('price_usd', 'size_m2')}) AS o FROM clean_khmer24)",
    "line_rules": f"SELECT CASE WHEN rejects <> '' THEN 'rejected' WHEN reviews <> '' THEN 'review' ELSE 'accepted' END AS record_status, rejects, reviews, count(*) AS n FROM (SELECT {_REJ} AS rejects, {_REV} AS reviews FROM lineitem) GROUP BY ALL",
    "rule_reasons": "SELECT reason, count(*) AS n FROM (SELECT 'returned' AS reason FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'tiny' FROM lineitem WHERE l_quantity < 2 UNION ALL SELECT 'big' FROM lineitem WHERE l_quantity > 45) GROUP BY 1",
    "resolved_floor": f"WITH c AS (SELECT listing_id, {_LEVEL.format('description', 'level')} AS d, {_LEVEL.format('title', 'floor')} AS t, unit_floor AS f FROM clean_khmer24), v AS (SELECT listing_id, CASE WHEN d BETWEEN 1 AND 100 THEN d END AS d, CASE WHEN t BETWEEN 1 AND 100 THEN t END AS t, CASE WHEN f BETWEEN 1 AND 100 THEN f END AS f FROM c) SELECT listing_id, coalesce(f, t, d) AS floor, CASE WHEN f IS NOT NULL THEN 'field' WHEN t IS NOT NULL THEN 'title' WHEN d IS NOT NULL THEN 'description' END AS source, CAST((CASE WHEN t IS NOT NULL AND d IS NOT NULL AND d <> t THEN 1 ELSE 0 END) + (CASE WHEN f IS NOT NULL AND coalesce(t, d) IS NOT NULL AND coalesce(t, d) <> f THEN 1 ELSE 0 END) AS INTEGER) AS n_conflicts FROM v",
    "recovered_districts": "WITH a AS (SELECT listing_id, project_name, district AS d0, coalesce(district, nullif(trim(regexp_extract(location_text, '^([^,]+),', 1)), '')) AS d1 FROM clean_khmer24), f AS (SELECT project_name, min(d1) AS d2 FROM a WHERE project_name IS NOT NULL AND d1 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT d1) = 1 AND count(*) >= 3) SELECT CASE WHEN d0 IS NOT NULL THEN 'original' WHEN d1 IS NOT NULL THEN 'location_text' WHEN d2 IS NOT NULL THEN 'project' END AS district_source, count(*) AS n, count(DISTINCT coalesce(d1, d2)) AS districts FROM a LEFT JOIN f USING (project_name) GROUP BY 1",
    "geocode_levels": "SELECT CASE WHEN project_name IS NOT NULL THEN 'project' WHEN address IS NOT NULL THEN 'address' WHEN location_text IS NOT NULL THEN 'location_text' WHEN district IS NOT NULL THEN 'district_only' ELSE 'insufficient' END AS level, count(*) AS n FROM clean_khmer24 GROUP BY 1",
    "coordinate_checks": "SELECT coord_id, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing' WHEN NOT (latitude BETWEEN 11.3 AND 11.8 AND longitude BETWEEN 104.7 AND 105.1) THEN 'invalid_outside' WHEN count(*) OVER (PARTITION BY latitude, longitude) > 1 THEN 'review_duplicate_coordinate' ELSE 'valid' END AS coordinate_check FROM validated_project_coordinates",
    "project_coordinates": "WITH o AS (SELECT project_name, min(latitude) AS la FROM validated_project_coordinates WHERE latitude IS NOT NULL AND project_name IS NOT NULL GROUP BY 1 HAVING min(latitude) = max(latitude)) SELECT CASE WHEN latitude IS NOT NULL THEN 'original' WHEN la IS NOT NULL THEN 'project' END AS latitude_source, count(*) AS n, round(avg(coalesce(latitude, la)), 4) AS mean_latitude FROM clean_khmer24 LEFT JOIN o USING (project_name) GROUP BY 1",
    "title_rooms": "WITH r AS (SELECT listing_id, " + _CLEAN.format("title") + " AS t, " + _rooms(_DIGITS.format("title")) + " AS rooms FROM clean_khmer24) SELECT listing_id, rooms, coalesce(" + _PLUS.format(1) + " + " + _PLUS.format(2) + ", " + _COUNTED + ") AS summed, coalesce(" + _PLUS.format(1) + ", " + _COUNTED + ") AS main, " + _PLUS.format(2) + " AS extra FROM r",
    "text_floors": "SELECT listing_id, " + ", ".join(f"{_first('t', p, lo, hi)} AS {n}" for n, p, lo, hi in (("floor", X.UNIT_FLOOR, 1, 100), ("total", X.TOTAL_FLOORS, 1, 150), ("baths", X.BATHROOMS, 0, 20))) + " FROM (SELECT listing_id, " + _DIGITS.format("description") + " AS t FROM clean_khmer24)",
    "recovered_rooms": _RECOVERED,
    "title_keys": f"SELECT listing_id, array_to_string(list_filter(string_split(regexp_replace(coalesce({_TITLE_KEY}, ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({_listed(T.TITLE_STOPWORDS)})), ' ') AS title_key FROM clean_harbor",
    "listing_labels": _LABELS,
}
