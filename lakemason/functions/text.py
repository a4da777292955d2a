"""Text cleaning and label functions: Column -> Column, inside the JVM.

Everywhere: null in, null out; a text that is blank after cleaning is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word edges. Java's \b disagrees with other engines beside Khmer vowel signs.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Words that say nothing about which flat a title means.
TITLE_STOPWORDS = (
    "for sale condo condominium apartment penthouse bedroom bedrooms br studio unit phnom penh cambodia property properties residence residences "
    "project type sqm sq m m2 floor floors fully furnished semi unfurnished new urgent hot best price available"
).split()
# What a listing is offered for.
SALE_LABELS, RENT_LABELS = ("sale", "for sale", "sell", "buy"), ("rent", "for rent", "rental", "lease")
BOTH_LABELS = ("sale/rent", "sale & rent", "sale and rent", "for sale or rent", "for sale and rent")
# Spelling of property types.
TYPE_LABELS = {
    "condo": "Condo", "condominium": "Condo", "penthouse": "Penthouse", "studio": "Studio", "apartment": "Apartment", "serviced apartment": "Serviced Apartment", "project": "Project",
    "house": "House", "villa": "Villa", "land": "Land", "commercial": "Commercial", "office": "Commercial", "flat": "Flat",
}


def bound(value: Column, use) -> Column:
    """use(value), with an expensive value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def matched(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null without one (the plain function gives '')."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def clean_text(c: Column) -> Column:
    """No-break spaces become blanks, zero-width marks go, runs of white space become one blank."""
    plain = F.translate(c, "\u00a0\u200b\ufeff", " ")
    return blank_to_null(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def first_label(c: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The label of the first pattern that matches; rules in order, patterns case-insensitive."""
    out = F.coalesce(*[F.when(c.rlike(f"(?i){pattern}"), F.lit(label)) for pattern, label in rules])
    return out if default is None else F.coalesce(out, default)


def all_labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Sorted distinct labels of all patterns that match."""
    found = F.array(*[F.when(c.rlike(f"(?i){pattern}"), F.lit(label)) for pattern, label in rules])
    return F.sort_array(F.array_distinct(F.array_compact(found)))


def match_status(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, "none").when(F.size(labels) == 1, "single").otherwise("ambiguous")


def mapped(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small mapping by key; ``default`` (or null) for keys that it lacks."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    got = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("string")
    return got if default is None else F.coalesce(got, default)


def listing_type(c: Column) -> Column:
    """sale, rent or sale/rent: whole labels first, then words; other labels in small letters."""
    low = F.lower(clean_text(c))
    sale, rent = (low.rlike(f"{LEFT}(?:{words}){RIGHT}") for words in ("sale|sell|buy", "rent|rental|lease"))
    return (
        F.when(low.isin(*BOTH_LABELS), "sale/rent").when(low.isin(*SALE_LABELS), "sale").when(low.isin(*RENT_LABELS), "rent")
        .when(sale & rent, "sale/rent").when(sale, "sale").when(rent, "rent").otherwise(low)
    )


def title_case(c: Column) -> Column:
    """Capital at the start of every run of letters, also behind digits and hyphens."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def type_label(c: Column) -> Column:
    text = clean_text(c)
    return mapped(F.lower(text), TYPE_LABELS, title_case(text))


def name_key(c: Column) -> Column:
    """Small letters, everything but a-z and 0-9 one blank; '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", " ")), F.lit(""))


def resolve_place(c: Column, aliases: dict[str, str], parts: dict[str, str]) -> Column:
    """A place by its squeezed key: alias, then part -> whole, then the longest alias within, else title case."""
    text = clean_text(c)
    key = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    squeeze = lambda m: {"".join(ch for ch in k.lower() if ch.isascii() and ch.isalnum()): v for k, v in m.items()}
    alias, part = squeeze(aliases), squeeze(parts)
    within = [F.when(key.contains(k), F.lit(v)) for k, v in sorted({**part, **alias}.items(), key=lambda kv: (-len(kv[0]), kv[0])) if k]
    return F.coalesce(mapped(key, alias), mapped(key, part), *within, title_case(text))


def title_key(c: Column) -> Column:
    """A title without prices, sizes, floors, room counts and stop words: what it says about which flat.

    Dashes and underscores are blanks. A currency sign only goes where a word character
    stands before it, so " $95,000" leaves the tokens 95 and 000.
    """
    text = F.translate(F.lower(clean_text(c)), "éèê–—-_", "eee    ")
    for pattern in (
        r"\b(?:usd|us\$|\$)\s*[\d,.]+\b",
        r"\b\d+(?:\.\d+)?\s*(?:sqm|sq\.?\s*m|m2|m²)(?![a-z0-9_])",
        r"\b\d+(?:st|nd|rd|th)?\s+floor\b",
        r"\b\d+\s*(?:bed|beds|bedroom|bedrooms|br)\b",
    ):
        text = F.regexp_replace(text, pattern, " ")
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOPWORDS))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def signature_text(c: Column) -> Column:
    """Small letters; everything but letters, digits, underscores and Khmer one blank."""
    return blank_to_null(F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\wក-៿]+", " ")))


def strip_suffixes(c: Column, patterns: list[str]) -> Column:
    """Remove anchored endings, one pattern after the other, and white space before them."""
    return blank_to_null(F.trim(reduce(lambda t, p: F.regexp_replace(t, rf"(?i)\s*(?:{p})\s*$", ""), patterns, c)))


# Endings of card titles such as "21h •" or "Jun 14 •".
AGE_ENDINGS = [r"\d+\s*(?:m|h|d|w|mo|y)\s*•", r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}\s*•"]


def collapse_repeat(c: Column, limit: int = 300) -> Column:
    """A title repeated on its card once: the phrase up to its own repetition, counters dropped."""
    text = clean_text(c)
    phrase = F.coalesce(matched(text, r"^(.{8,}?)(?:\s+\d{1,3})?\s+\1", 1), text)
    return F.left(F.trim(F.regexp_replace(phrase, r"\s+\d{1,3}$", "")), F.lit(limit))


def excerpt(c: Column, limit: int = 1500) -> Column:
    """Up to ``limit`` characters, then three dots where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.left(c, F.lit(limit))), F.lit("..."))).otherwise(c)


def normalize_url(c: Column) -> Column:
    """Scheme and host in small letters, no query, fragment or closing slash."""
    text = clean_text(c)
    bare = F.regexp_replace(text, r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?", 1)
    path = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), "/+$", "")
    return F.coalesce(blank_to_null(F.concat(F.lower(head), path)), text)


def url_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "^/+|/+$", "")


def path_shape(c: Column) -> Column:
    """The first two short path segments without long numbers, then one star for the rest."""
    parts = F.split(url_path(c), "/")
    plain = lambda p: ~p.rlike(r"\d{3,}") & (F.length(p) < 20)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shape = F.when(~plain(first), "/*").when(second.isNull(), F.concat(F.lit("/"), first)).when(~plain(second), F.concat(F.lit("/"), first, F.lit("/*")))
    two = F.concat(F.lit("/"), first, F.lit("/"), second)
    return F.when(url_path(c) == "", "/").otherwise(F.coalesce(shape, F.when(F.size(parts) > 2, F.concat(two, F.lit("/*"))).otherwise(two)))


def has_hint(c: Column, hints: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(h) for h in hints])


def page_url(base: Column, page: Column, style: str = "query", name: str = "page") -> Column:
    """The address of a result page: ?page=2, /2 or /page/2; the first page is the base."""
    trimmed = F.regexp_replace(base, "/+$", "")
    tail = {"query": F.concat(F.when(trimmed.contains("?"), "&").otherwise("?"), F.lit(f"{name}="), page.cast("string")), "path": F.concat(F.lit("/"), page.cast("string")), "paged": F.concat(F.lit(f"/{name}/"), page.cast("string"), F.lit("/"))}[style]
    return F.when(page <= 1, base).otherwise(F.concat(trimmed, tail))


def digits_code(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, "[^0-9]", ""))


def letter_code(c: Column) -> Column:
    """One to three letters and five digits or more, as a whole, in capitals; else null."""
    code = F.upper(clean_text(c))
    return F.when(code.rlike(r"^[A-Z]{1,3}\d{5,}$"), code)


def chosen_code(from_url: Column, raw: Column) -> Column:
    """struct(value, note): the address's code wins; a differing other one is noted."""
    differ = from_url.isNotNull() & raw.isNotNull() & (from_url != raw)
    return F.struct(F.coalesce(from_url, raw).alias("value"), F.when(differ, F.concat(F.lit("code_mismatch:"), raw, F.lit(" -> "), from_url)).alias("note"))


def slug(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(url_path(c), r"([^/]+)$", 1))


def slug_with_hash(c: Column, size: int = 8) -> Column:
    return F.concat(slug(c), F.lit("-"), F.left(F.sha1(c), F.lit(size)))


def location_parts(c: Column) -> Column:
    """struct(district, commune): the last but one and last but two of comma-separated parts."""
    parts = F.filter(F.transform(F.split(clean_text(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("district"), F.try_element_at(parts, F.lit(-3)).alias("commune"))


def last_match(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The last match of the first pattern that matches at all."""
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(group)), F.lit(-1)) for p in patterns])


def prefixed_id(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def group_id(value: Column, source: str, kind: str) -> Column:
    """source_kind_ and twelve hex digits of the value's SHA-1."""
    return F.concat(F.lit(f"{source}_{kind}_"), F.left(F.sha1(value), F.lit(12)))


def evidence_text(*parts: Column, sep: str = " ") -> Column:
    """Parts in order, null as empty text, so that separators stay where they stand."""
    return F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])


def word_count(html: Column) -> Column:
    """Words outside of tags."""
    return F.size(F.filter(F.split(F.regexp_replace(html, "<[^>]*>", " "), r"\s+"), lambda w: w != ""))


def stated_total(c: Column, patterns: list[str], low: int = 5, high: int = 200_000) -> Column:
    """The largest number that any pattern states, years (1900..2100) and numbers out of range left out."""
    every = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns]))
    numbers = F.transform(every, lambda v: F.regexp_replace(v, ",", "").try_cast("int"))
    return F.array_max(F.filter(numbers, lambda n: n.between(low, high) & ~n.between(1900, 2100)))


def short_usd(c: Column) -> Column:
    return F.when(c >= 1e6, F.format_string("$%.1fM", c / 1e6)).when(c >= 1e3, F.format_string("$%.1fK", c / 1e3)).when(c.isNotNull(), F.format_string("$%.0f", c.cast("double")))


def ordered_reasons(*reasons: Column) -> Column:
    """Distinct non-null texts in first-seen order, joined by '; '; null when there are none."""
    return blank_to_null(F.array_join(F.array_distinct(F.array_compact(F.array(*reasons))), "; "))


def first_filled(*columns: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def phrase_rules(places: dict[str, str], templates: list[str]) -> list[tuple[str, str]]:
    """Rules for first_label and all_labels: a place's pattern within phrases such as 'located in {}'."""
    phrases = "|".join(t.replace("{}", "(?:{0})") for t in templates)
    return [(phrases.replace("{0}", pattern), label) for pattern, label in places.items()]
