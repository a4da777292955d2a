"""Fields out of free text by ordered patterns: Column -> Column, inside the JVM.

Patterns are plain data, tried in order, case-insensitive; a value out of range passes on to
the next pattern. Results are struct(value, raw) where the matched text matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakemason.functions.text import LEFT, RIGHT, bound, clean_text, matched

SQFT_M2 = 0.092903
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

# How counts of rooms and floors are written, in English and Khmer.
BEDROOMS = [r"(?<!\d)(\d{1,2})\s*[- ]?\s*(?:bed(?:room)?s?|br|bdr)" + RIGHT, LEFT + r"(?:bed(?:room)?s?)\s*[:\-]?\s*(\d{1,2})" + RIGHT, r"(?<!\d)(\d{1,2})\s*បន្ទប់គេង", r"បន្ទប់គេង\s*[:\-]?\s*(\d{1,2})"]
BATHROOMS = [r"(?<!\d)(\d{1,2})\s*[- ]?\s*(?:bath(?:room)?s?|ba)" + RIGHT, LEFT + r"(?:bath(?:room)?s?)\s*[:\-]?\s*(\d{1,2})" + RIGHT, r"(?<!\d)(\d{1,2})\s*បន្ទប់ទឹក", r"បន្ទប់ទឹក\s*[:\-]?\s*(\d{1,2})"]
UNIT_FLOOR = [
    LEFT + r"(?:located|situated)\s+on\s+(?:the\s+)?(\d{1,3})(?:st|nd|rd|th)?\s+floor" + RIGHT, LEFT + r"unit\s+(?:is\s+)?(?:located\s+)?on\s+(?:the\s+)?(\d{1,3})(?:st|nd|rd|th)?\s+floor" + RIGHT,
    LEFT + r"on\s+(?:the\s+)?(\d{1,3})(?:st|nd|rd|th)?\s+floor" + RIGHT, LEFT + r"(\d{1,3})(?:st|nd|rd|th)\s+floor" + RIGHT, LEFT + r"floor\s+level\s*[:\-]\s*(\d{1,3})" + RIGHT,
    LEFT + r"unit\s+floor\s*[:\-]\s*(\d{1,3})" + RIGHT, LEFT + r"level\s*[:\-]\s*(\d{1,3})" + RIGHT, LEFT + r"(\d{1,3})\s*f" + RIGHT, r"ជាន់ទី\s*(\d{1,3})", r"ជាន់\s*[:\-]?\s*(\d{1,3})",
]
_STOREY = r"(?:storey|storeys|story|stories)"
TOTAL_FLOORS = [
    LEFT + rf"(\d{{1,3}})\s*{_STOREY}\s+high" + RIGHT, LEFT + rf"(\d{{1,3}})\s*[- ]\s*{_STOREY}\s+(?:building|tower)" + RIGHT, LEFT + r"(\d{1,3})\s+floors?\s+(?:building|tower)" + RIGHT,
    LEFT + r"total\s+floors?\s*[:\-]\s*(\d{1,3})" + RIGHT, LEFT + r"building\s+(?:has|with)\s+(\d{1,3})\s+floors?" + RIGHT, LEFT + rf"(\d{{1,3}})\s*[- ]\s*{_STOREY}\s+(?:tower|condominium|development)" + RIGHT,
]


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "០១២៣៤៥៦៧៨៩", "0123456789")


def first_in_range(c: Column, patterns: list[str], low: int, high: int) -> Column:
    """struct(value, raw) of the first pattern whose first match is in range; null if none is."""

    def one(text: Column, pattern: str) -> Column:
        raw = lambda v: F.struct(v.alias("value"), F.regexp_extract(text, f"(?i){pattern}", 0).alias("raw"))
        return bound(matched(text, f"(?i){pattern}", 1).try_cast("int"), lambda v: F.when(v.between(low, high), raw(v)))

    return bound(ascii_digits(clean_text(c)), lambda text: F.coalesce(*[one(text, p) for p in patterns]))


def bedrooms(c: Column) -> Column:
    studio = lambda raw: F.when(raw.isNotNull(), F.struct(F.lit(0).alias("value"), raw.alias("raw")))
    return F.coalesce(first_in_range(c, BEDROOMS, 0, 15), bound(matched(clean_text(c), rf"(?i){LEFT}studio{RIGHT}"), studio))


def bathrooms(c: Column) -> Column:
    return first_in_range(c, BATHROOMS, 0, 20)


def unit_floor(c: Column) -> Column:
    return first_in_range(c, UNIT_FLOOR, 1, 100)


def total_floors(c: Column) -> Column:
    return first_in_range(c, TOTAL_FLOORS, 1, 150)


def rooms_not_after(c: Column, pattern: str, banned: str, low: int = 0, high: int = 15, reach: int = 30) -> Column:
    """The first of all matches in range that has no banned word in the ``reach`` characters before it."""
    pieces = F.regexp_extract_all(clean_text(c), F.lit(f"(?is)(.{{0,{reach}}}?)({pattern})"), F.lit(0))
    kept = F.filter(pieces, lambda p: ~p.rlike(f"(?is){banned}.{{0,{reach}}}{pattern}"))
    numbers = F.transform(kept, lambda p: F.regexp_extract(p, f"(?is){pattern}", 1).try_cast("int"))
    return F.get(F.filter(numbers, lambda n: n.between(low, high)), F.lit(0))


def title_bedrooms(c: Column, plus: str = "sum") -> Column:
    """Rooms of a title: studio 0, 'a+b' as sum or first, digits, number words."""
    text = F.lower(clean_text(c))
    a, b = (matched(text, r"(\d{1,2})\s*\+\s*(\d{1,2})\s*-?\s*(?:bed|br)", g).try_cast("int") for g in (1, 2))
    words = F.coalesce(*[F.when(text.rlike(rf"{LEFT}{w}[\s-]+bed"), F.lit(n)) for w, n in NUMBER_WORDS.items()])
    count = matched(text, r"(?<![\d+])(\d{1,2})\s*-?\s*(?:bed|br)", 1).try_cast("int")
    studio = F.when(text.rlike(rf"{LEFT}studio{RIGHT}"), 0)
    return F.coalesce(a + b if plus == "sum" else a, studio, count, words)


def extra_rooms(c: Column) -> Column:
    """struct(main, extra) of '3+1': the rooms and the extra one."""
    text = F.lower(clean_text(c))
    return F.struct(*[matched(text, r"(\d{1,2})\s*\+\s*(\d{1,2})\s*-?\s*(?:bed|br)", g).try_cast("int").alias(n) for g, n in ((1, "main"), (2, "extra"))])


def bedroom_options(c: Column) -> Column:
    """Sorted distinct room counts of '1 & 2 bedrooms' or '1/2/3 BR'; null unless there are several."""
    listed = matched(F.lower(clean_text(c)), r"((?:\d{1,2}\s*(?:&|/|,|and|or)\s*)+\d{1,2})\s*-?\s*(?:bed|br)", 1)
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(listed, F.lit(r"(\d{1,2})"), F.lit(1)), lambda n: n.cast("int"))))
    return F.when(F.size(numbers) > 1, numbers)


def option_list(c: Column) -> Column:
    """Integers from 0 on, sorted and distinct; null for none."""
    kept = F.array_sort(F.array_distinct(F.filter(c, lambda n: n.isNotNull() & (n >= 0))))
    return F.when(F.size(kept) > 0, kept)


def transaction_type(title: Column) -> Column:
    """sale, rent or sale/rent from a title, phrases of rental income left out first."""
    low = F.regexp_replace(F.lower(clean_text(title)), r"(?:guaranteed\s+)?rent(?:al)?\s+(?:yield|return|income|guarantee)s?", " ")
    sale, rent = low.rlike(rf"{LEFT}(?:sale|sell|buy){RIGHT}"), low.rlike(rf"{LEFT}(?:rent|rental|lease){RIGHT}")
    return F.when(sale & rent, "sale/rent").when(sale, "sale").when(rent, "rent")


def amount(c: Column, low: float = 0, high: float = float("inf"), whole: bool = True) -> Column:
    """A price with K or M behind it; null for words such as negotiable, and out of range."""
    text = F.upper(clean_text(c))
    number = F.regexp_replace(matched(text, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
    unit = F.regexp_extract(text, r"\d[\d,]*(?:\.\d+)?\s*([KM])(?![A-Z0-9²])", 1)
    value = number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    value = F.floor(value).cast("double") if whole else value
    return F.when(~text.rlike("NEGOTIABLE|POA|ON REQUEST|CONTACT") & (value > low) & (value <= high), value)


def size_m2(c: Column, low: float = 0, high: float = float("inf")) -> Column:
    """A size in square metres; square feet are converted, two decimals."""
    text = F.lower(clean_text(c))
    number = F.regexp_replace(matched(text, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
    value = F.round(F.when(text.rlike(r"sq\.?\s*f|ft"), number * SQFT_M2).otherwise(number), 2)
    return F.when((value > low) & (value <= high), value)


def first_int(c: Column, signed: bool = True) -> Column:
    return matched(c, r"-?\d+" if signed else r"\d+").try_cast("int")


def safe_float(c: Column) -> Column:
    """The first number of a text without $, commas and USD; null without one."""
    return matched(F.regexp_replace(F.trim(c), r"\$|,|USD|usd", ""), r"-?\d+(?:\.\d+)?").try_cast("double")


def safe_int(c: Column) -> Column:
    """A whole number; null where the number has a fraction."""
    number = safe_float(c)
    return F.when(number == F.floor(number), number).try_cast("int")


def marked_amounts(c: Column, low: float = 10_000, high: float = 20_000_000) -> Column:
    """All amounts beside a currency mark within range."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?:\$|usd)\s*(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    numbers = F.transform(found, lambda v: F.regexp_replace(v, ",", "").try_cast("double"))
    return F.filter(numbers, lambda n: n.between(low, high))


def near_label(c: Column, labels: str, unit: str = r"(?:sqm|m2|m²|㎡|平方米)") -> Column:
    """The number with a unit that follows a label within ten characters."""
    return matched(c, rf"(?i)(?:{labels})[^0-9]{{0,10}}(\d+(?:\.\d+)?)\s*{unit}", 1).try_cast("double")


def label_value(c: Column, label: str) -> Column:
    """What stands behind 'label:' up to the end of the line."""
    return clean_text(matched(c, rf"(?im)(?:^|\n|\s){label}\s*[:：]\s*([^\n;|]+)", 1))


def agreed_label(c: Column, places: dict[str, str]) -> Column:
    """The one whole that all parts named in a text belong to; null for none or several."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.lower(c).contains(p.lower()), F.lit(w)) for p, w in places.items()])))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))
