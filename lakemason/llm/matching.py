"""Matching entities of two sources that share no identifier.

Method: a deterministic rule cascade. Each rule is an exact join on a weaker combination of
attributes than the one before; records that a rule resolves leave before the next. Each
rule's confidence is its labelled precision, smoothed: labels are the numbers of bedrooms,
which no rule looks at. Pairs that agree in them speak for the rule, as far as
they agree more often than two adverts of one building and size do by chance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemason.functions.names import ROMAN, Pattern, name_words
from lakemason.sources.tables import cut_lineage

PRICE_TOLERANCE, SIZE_TOLERANCE, FLOOR_TOLERANCE = 0.04, 0.03, 1
SQFT_M2 = 0.092903
# Nouns that end a building's name, with the spellings that mean the same.
KINDS = {
    "residence": "residence", "res": "residence", "resid": "residence", "residences": "residences", "tower": "tower", "towers": "towers", "condo": "condo", "condominium": "condo", "suites": "suites", "lofts": "lofts",
    "living": "living", "city": "city", "point": "point", "place": "place", "park": "park", "court": "court", "heights": "heights", "mansion": "mansion",
}
# Words of adverts that are no part of a building's name.
PLAIN = frozenset("the a an at in on for of and near by with sale rent floor level view side home corner condo penthouse apartment studio room br bed beds bedroom bedrooms bath city new good area urgent building one two three four five six repost re post".split())
BED_WORDS = frozenset("br bed beds bedroom bedrooms".split())

_PRICE = re.compile(r"(?:\$|USD|US\$)\s?(\d[\d,]*(?:\.\d+)?)\s?([KM](?![a-z0-9²]))?|(?<![\d.])(\d[\d,]*(?:\.\d+)?)\s?([KM])(?![A-Za-z0-9²])", re.I)
_SIZE = re.compile(r"(?<![\d.])(\d+(?:\.\d+)?)\s?(sqm|m2|m²|sq\.?\s?m|sqft|sq\.?\s?ft)(?![a-z])", re.I)
_FLOOR = re.compile(r"\b(?:floor|level)\s+(\d{1,3})\b", re.I)

PROFILE = "id string, price double, size double, floor int, rooms int, address string, exact array<string>, loose array<struct<key: string, rest: string>>"


def title_facts(title: str | None) -> tuple[float | None, float | None, int | None]:
    """(price in dollars, size in m2, floor) as far as the title tells them."""
    price = size = floor = None
    if title:
        if m := _PRICE.search(title):
            number, unit = (m[1], m[2]) if m[1] else (m[3], m[4])
            price = float(number.replace(",", "")) * {"K": 1e3, "M": 1e6}.get((unit or "").upper(), 1)
        if m := _SIZE.search(title):
            size = float(m[1]) * (SQFT_M2 if "f" in m[2].lower() else 1)
        if m := _FLOOR.search(title):
            floor = int(m[1])
    return price, size, floor


def _suffix(words: list[str]) -> str:
    """What tells phases and towers of a name apart, from the words after its kind."""
    words = [ROMAN.get(w, w) for w in words[:3]] + ["", "", ""]
    if words[0] in ("phase", "tower", "block") and len(words[1]) == 1:
        return f"{words[0]} {words[1]}"
    if words[0] in ("2", "3", "4", "5") and words[1] not in BED_WORDS:
        return words[0]
    return "grand" if words[0] == "grand" else ""


@lru_cache(maxsize=50_000)
def project_parts(text: str, whole: bool) -> tuple[str, str, str, str] | None:
    """(first word, second word, kind, phase) of the building's name in a text.

    whole: the text is the name itself, and is taken apart by place where its kind is unknown.
    """
    words = name_words(text)
    for i in range(2, len(words)):
        a, b = words[i - 2], words[i - 1]
        if words[i] in KINDS and a.isalpha() and b.isalpha() and len(a) > 2 and len(b) > 2 and a not in PLAIN and b not in PLAIN - {"view"}:
            return a, b, KINDS[words[i]], _suffix(words[i + 1 :])
    if not whole:
        return None
    words = words[1:] if words[:1] == ["the"] else words
    if len(words) < 2:
        return (words[0], "", "", "") if words else None
    return words[0], words[1], words[2] if len(words) > 2 else "", _suffix(words[3:])


def profiles(rows: DataFrame) -> DataFrame:
    """PROFILE of each listing_id: fields, completed from the title, and keys of the building."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                price, size, floor = title_facts(r.title)
                names = {p for p in (project_parts(r.project_name, True) if r.project_name else None, project_parts(r.title, False) if r.title else None) if p}
                exact = sorted(" ".join(p) for p in names)
                loose = sorted({(f"{k}|{' '.join(p[:k] + p[k + 1 :])}", p[k]) for p in names if p[1] for k in range(3)})
                known = lambda v: None if v is None or v != v or v <= 0 else float(v)
                unit_floor = None if r.unit_floor is None or r.unit_floor != r.unit_floor else int(r.unit_floor)
                out.append((r.listing_id, known(r.price_usd) or known(price), known(r.size_m2) or known(size), floor if unit_floor is None else unit_floor, None if r.rooms is None or r.rooms != r.rooms else int(r.rooms), " ".join(name_words(r.address, False)) if r.address else None, exact, [{"key": a, "rest": b} for a, b in loose]))
            frame = pd.DataFrame(out, columns=["id", "price", "size", "floor", "rooms", "address", "exact", "loose"])
            yield frame.astype({"floor": "Int32", "rooms": "Int32"})

    one = rows.select("listing_id", "title", "project_name", F.col("price_usd").cast("double"), F.col("size_m2").cast("double"), F.col("unit_floor").cast("int"), F.col("bedrooms").cast("int").alias("rooms"), "address").where(F.col("listing_id").isNotNull())
    made = one.mapInPandas(make, PROFILE)
    # rows that repeat an id are one advert; the fullest profile stands for it
    full = F.struct(F.size("exact"), *[F.col(c).isNotNull() for c in ("price", "size", "floor", "address")], *["price", "size", "floor", "rooms", "address", "exact", "loose"])
    best = made.groupBy("id").agg(F.max(full).alias("m"))
    return best.select("id", *[F.col(f"m.{c}").alias(c) for c in ("price", "size", "floor", "rooms", "address", "exact", "loose")])


def _place(value: Column, tolerance: float) -> Column:
    """Where a value stands among logarithmic bands twice as wide as the tolerance."""
    return F.log(value) / F.lit(-2 * math.log(1 - tolerance))


def band(value: Column, tolerance: float) -> Column:
    return F.floor(_place(value, tolerance))


def _around(value: Column, tolerance: float) -> Column:
    """The two bands (three at a very edge) in which all values within the tolerance lie."""
    place = _place(value, tolerance)
    return F.explode(F.sequence(F.floor(place - 0.5 - 1e-9), F.floor(place + 0.5 + 1e-9)))


def _close(a: Column, b: Column, tolerance: float) -> Column:
    """True where known and close, null where one is unknown."""
    return F.abs(a - b) <= tolerance * F.greatest(a, b)


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Are two words the same but for a slip or two?"""
    return pd.Series([x == y or Pattern(x).likeness(y) >= 0.6 for x, y in zip(a, b, strict=True)], dtype=bool)


def chance(rows: DataFrame) -> float:
    """How often two profiles of one building and size band agree in their rooms."""
    known = rows.where("rooms is not null and size is not null").select(F.explode("exact").alias("k"), band(F.col("size"), SIZE_TOLERANCE).alias("band"), "rooms")
    each = known.groupBy("k", "band", "rooms").agg(F.count("*").cast("double").alias("n"))
    all_ = each.groupBy("k", "band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    same, pairs = all_.agg(F.sum("same"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    return ((same or 0.0) + 1) / ((pairs or 0.0) + 2)


def labelled_precision(agree: int, known: int, by_chance: float) -> float:
    """The smoothed share of labelled pairs that agree, freed from agreement by chance."""
    return max(0.0, ((agree + 1) / (known + 2) - by_chance) / (1 - by_chance))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, rule, confidence) of records that describe one flat.

    left and right are adverts with listing_id, title, project_name, price_usd, size_m2,
    unit_floor, bedrooms and address; what a field lacks is read from the title.
    Pairs need the same building (phases and towers are buildings of their own), and price,
    size and floor within the tolerances as far as both tell them; of price and size at least
    one, and where size is unknown also the floor, must be known to agree. Records that tell
    neither building nor address match nothing. Every pair of the first rule that resolves a
    right record is given; a left record may match several right ones. A rule without a
    labelled pair gets the confidence of no evidence. Null ids, empty tables and repeated
    rows are allowed; ties all stay. Joins are merge joins: nothing is gathered in the driver.
    """
    lefts, rights = cut_lineage(profiles(left)), cut_lineage(profiles(right))
    facts = ["id", "price", "size", "floor", "rooms"]

    def side(rows: DataFrame, tag: str, key: Column, rest: Column | None, bands: list[tuple[str, float]], around: bool) -> DataFrame:
        keyed = rows.select(*facts, key.alias("k")) if rest is None else rows.select(*facts, F.explode("loose").alias("l")).select(*facts, F.col("l.key").alias("k"), F.col("l.rest").alias("rest"))
        for column, tolerance in bands:
            keyed = keyed.where(F.col(column).isNotNull()).withColumn(f"band_{column}", _around(F.col(column), tolerance) if around else band(F.col(column), tolerance))
        hashed = F.xxhash64("k", *[f"band_{c}" for c, _ in bands])
        return keyed.where("k is not null").select(hashed.alias("h"), *[F.col(c).alias(f"{tag}_{c}") for c in facts], *([] if rest is None else [F.col("rest").alias(f"{tag}_rest")]))

    both = [("price", PRICE_TOLERANCE), ("size", SIZE_TOLERANCE)]
    exact, loose, address = F.explode("exact"), F.lit(True), F.col("address")
    no_size, no_price = F.col("size").isNull(), F.col("price").isNull()
    unnamed = F.size("exact") == 0
    # name of the rule, key, compare the rest of the key?, bands, which left and right records take part
    rules = [
        ("building_price_size", exact, None, both, [(None, None)]),
        ("slip_price_size", None, loose, both, [(None, None)]),
        ("building_size", exact, None, both[1:], [(no_price, None), (None, no_price)]),
        ("building_price_floor", exact, None, both[:1], [(no_size, None), (None, no_size)]),
        ("address_price_size", address, None, both, [(unnamed, None), (None, unnamed)]),
    ]
    price, size = _close(F.col("a_price"), F.col("b_price"), PRICE_TOLERANCE), _close(F.col("a_size"), F.col("b_size"), SIZE_TOLERANCE)
    floor = F.abs(F.col("a_floor") - F.col("b_floor")) <= FLOOR_TOLERANCE
    yes = lambda c: F.coalesce(c, F.lit(True))
    hits: list[DataFrame] = []
    open_ = rights
    for name, key, rest, bands, takes in rules:
        met = None
        for only_left, only_right in takes:
            a = side(lefts if only_left is None else lefts.where(only_left), "a", key, rest, bands, True)
            b = side(open_ if only_right is None else open_.where(only_right), "b", key, rest, bands, False)
            pairs = a.hint("merge").join(b.hint("merge"), "h")
            met = pairs if met is None else met.unionByName(pairs)
        fits = yes(price) & yes(size) & yes(floor)
        if name == "building_price_floor":
            fits = fits & floor.isNotNull()
        met = met.where(fits)
        if rest is not None:
            met = met.where(alike("a_rest", "b_rest"))
        agree = (F.col("a_rooms") == F.col("b_rooms")).alias("agree")
        hits.append(cut_lineage(met.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), F.lit(name).alias("rule"), agree).groupBy("left_id", "right_id", "rule").agg(F.max("agree").alias("agree"))))
        open_ = open_.join(hits[-1].select(F.col("right_id").alias("id")).distinct().hint("merge"), "id", "left_anti")
    found = reduce(DataFrame.unionByName, hits)
    counts = {r["rule"]: (r["agree"], r["known"]) for r in found.groupBy("rule").agg(F.count_if("agree").alias("agree"), F.count("agree").alias("known")).collect()}  # one row a rule
    by_chance = chance(rights)
    confidence = F.coalesce(*[F.when(F.col("rule") == name, F.lit(labelled_precision(*counts.get(name, (0, 0)), by_chance))) for name, *_ in rules])
    return found.select("left_id", "right_id", "rule", confidence.alias("confidence"))
