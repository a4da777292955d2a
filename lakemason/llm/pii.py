"""Personal information inside free text: where it stands, of what type, and readable text without it.

Method: information-theoretic sanitisation. Phones, mail addresses, identity numbers and
street addresses have a fixed form and are found as such; they, and forms of address, mark
protected positions. From the co-occurrence of every term with such positions over the whole
corpus comes the information, in bits, that the term discloses about a person standing there.
Terms above the threshold are names wherever they stand, with or without a cue, in any case.
What is found is generalised to its type: a placeholder takes its place.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemason.llm.sieve import slot_bits
from lakemason.sources.tables import cut_lineage

#: A term is a name where it discloses this share of the bits that it takes to point at a
#: protected position (1 where it stands nowhere else, 0 where protection is as likely as
#: anywhere)...
DISCLOSURE = 0.8
#: ...and where it is protected so often at least: once or twice may be chance.
LEAST = 3
#: Slots of the sieve that tells likely terms before they are looked up: fixed, whatever the number of terms.
SIEVE = 1 << 24
TYPES = ("email", "id_number", "phone", "address", "name")

# Other digits than ASCII, one code point for one.
_OTHER_DIGIT = re.compile("[០-៩０-９]")
#: Everything in ASCII but letters parts words.
_PARTS = {i: " " for i in range(128) if not chr(i).isalpha()}
_S = r"[ .\-/\u00a0]"
_N = "[0-9O]"
_PHONE = re.compile(  # begins with one of four characters, which the search skips to
    rf"[(+0O](?<![\w+].)(?:"
    rf"(?:(?<=\()\+855\)|(?<=\+)855|(?<=0)0855|(?<=\()00855\)){_S}?(?:\(?0?{_N}{{2}}\)?{_S}?{_N}{{3}}{_S}?{_N}{{3,4}})"
    rf"|(?<=\()[0O][1-9O]{_N}\){_S}?{_N}{{3}}{_S}?{_N}{{3,4}}"
    rf"|(?<=[0O])(?<!\d[.,/].)[1-9O]{_N}{_S}?{_N}{{3}}{_S}?{_N}{{3,4}}"
    rf"|(?<=[0O]) [1-9](?: {_N}){{7,8}}"
    rf")(?!\w)"
)
_CODE_BEFORE = re.compile(r"(?:code|ref|listing no|no|number|plan|lot)[.:]?\s*$", re.I)
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_SPELLED = r"(?:\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_LOCAL, _LABEL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*", r"[A-Za-z0-9-]+"
# Ends of addresses that tell "x at y.com" from a sentence that lacks a blank.
_ENDINGS = ("com", "org", "net", "info", "biz", "edu", "gov", "kh", "example", "test")
#: (pattern, what no match can lack: one of these marks in the text, or one of these words).
_EMAILS = (
    (re.compile(rf"{_LOCAL}(?:\s?@\s?|\s?\[at\]\s?|\s?\(at\)\s?){_LABEL}(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+", re.I), ("@", "[at]", "(at)"), frozenset()),
    (re.compile(rf"{_LOCAL}\sat\s{_LABEL}(?:{_DOT}{_LABEL})*?{_SPELLED}[A-Za-z][A-Za-z0-9-]*(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)*", re.I), (), frozenset(["dot"])),
    (re.compile(rf"{_LOCAL}\sat\s{_LABEL}(?:\.{_LABEL})*?\.(?:{'|'.join(_ENDINGS)})(?![\w-])", re.I), (), frozenset(_ENDINGS)),
)
_ID = re.compile(r"[A-Z]-?\d{4}-?\d{3,4}(?!\w)|\d{3}[ -]?\d{3}[ -]?\d{3}(?:\s?\(\d{1,2}\))?(?!\w)", re.I)
_ID_LABEL = re.compile(r"id card|identity card|passport|អត្តសញ្ញាណប័ណ្ណ|លិខិតឆ្លងដែន|身份证|护照", re.I)
#: No label lacks all of these.
_ID_PARTS = ("card", "passport", "អត្ត", "លិខិត", "证", "护照")
#: What follows a number that is told by what follows: no match lacks all of these.
_ID_ENDS = (" name", " on file")
_ID_GAP = re.compile(r"(?:លេខ|号码|号|no\.?|number)?[\s::#]*", re.I)
_ID_TAIL = re.compile(r"(?<![\w+.-])([A-Z]-?\d{4}-?\d{3,4}|\d{3}[ -]?\d{3}[ -]?\d{3}(?:\s?\(\d{1,2}\))?)(?=\s?,? (?:name|on file)\b)", re.I)
_ROAD = "road|boulevard|avenue|blvd|ave|street|lane"
_ROADS, _LABELS = frozenset(["st", *_ROAD.split("|")]), frozenset(["no", "house", "villa"])
#: (pattern, marks or words of which no match can lack one, and words of which it can't lack one beside).
_ADDRESSES = (
    (re.compile(r"(?:(?<!\w)(?:no\.?|house|villa)\s*|(?<![\w#])#\s?)\d+[a-z]?\d*,?\s+(?:(?:lane|borey)\s+\w+,?\s+)*(?:(?:street|st\.?)\s*\d+[a-z]?(?!\w)|[a-z]+\s+(?:" + _ROAD + r")(?!\w))", re.I), ("#",), _LABELS, _ROADS),
    (re.compile(r"(?<![\w$,.#])\d+[a-z]?\s+[a-z]{4,}\s+(?:road|boulevard|avenue)(?!\w)", re.I), (), frozenset(["road", "boulevard", "avenue"]), None),
    (re.compile(r"(?<![\w#])ផ្ទះ(?:លេខ)?\s*\d+[a-z]?\s*,?\s*ផ្លូវ(?:លេខ)?\s*\d+", re.I), ("ផ្ទះ",), frozenset(), None),
)
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+|[ក-៓ៜ៝]+|[一-鿿]+")
_LATIN_NAME = re.compile(r"[\s:]*((?:[A-Z]\.\s?)?[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,})?|[A-Z]\.\s?[A-Z][A-Za-z]{2,})")
_KHMER_NAME = re.compile(r"[\s:]*([ក-៓]+(?:\s+[ក-៓]+)?)(?=\s*(?:លេខ|។|,|$))")
_ENDS = re.compile(r"\s*(?:[,.()។，]|at\b|will\b|-|$|\n|[0-9+])")
_INITIAL = re.compile(r"(?<!\w)[A-Za-z]\.\s?$")
# Forms of address and words before a name; the form itself stays outside.
_TITLES = frozenset("mr ms mrs miss dr".split())
_CUES = frozenset("contact owner name call 联系人 លោក លោកស្រី ឈ្មោះ អ្នកស្រី អ្នក".split())
_FOR = frozenset("ask file".split())
_TRIGGERS = _TITLES | _CUES | _FOR
_NO_NAMES = frozenset("the our your this phone tel email mail contact owner seller condo penthouse street road whatsapp telegram villa house passport boulevard lane borey".split())


def ascii_digits(text: str) -> str:
    if text.isascii() or not _OTHER_DIGIT.search(text):
        return text
    return _OTHER_DIGIT.sub(lambda m: str(unicodedata.digit(m[0])), text)


def phones(plain: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(plain) if not _CODE_BEFORE.search(plain, max(0, m.start() - 14), m.start())]


def _may(low: str, seen: set[str], marks: tuple[str, ...], words: frozenset[str]) -> bool:
    return not words.isdisjoint(seen) or any(mark in low for mark in marks)


def fixed_details(text: str, seen: set[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with ASCII digits, spans of mail addresses, identity numbers, phones and addresses).

    seen: the text's _plain_words. A pattern is searched for where the text has what no match can lack.
    """
    plain = ascii_digits(text)
    spans: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in spans):
            spans.append((start, end, kind))

    low = plain.lower()
    for pattern, marks, words in _EMAILS:
        if _may(low, seen, marks, words):
            for m in pattern.finditer(plain):
                add(m.start(), m.end(), "email")
    if any(part in low for part in _ID_PARTS):
        for m in _ID_LABEL.finditer(plain):
            if v := _ID.match(plain, _ID_GAP.match(plain, m.end()).end()):
                add(v.start(), v.end(), "id_number")
    if any(end in low for end in _ID_ENDS):
        for m in _ID_TAIL.finditer(plain):
            add(m.start(1), m.end(1), "id_number")
    for start, end in phones(plain):
        add(start, end, "phone")
    for pattern, marks, words, beside in _ADDRESSES:
        if (beside is None or not beside.isdisjoint(seen)) and _may(low, seen, marks, words):
            for m in pattern.finditer(plain):
                add(m.start(), m.end(), "address")
    return plain, spans


def cued_names(text: str, words: list[tuple[str, int, int]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Capitalised (or Khmer) words that a cue marks as somebody's name."""
    found = []
    for i, (word, _, end) in enumerate(words):
        low = word.lower()
        if low in _TITLES:
            at = end + 1 if text[end : end + 1] == "." else end
            if m := _LATIN_NAME.match(text, at):
                found.append(m.span(1))
        elif low in _CUES or (low == "for" and i and words[i - 1][0].lower() in _FOR):
            m = _LATIN_NAME.match(text, end) or ("ក" <= word[0] <= "៿" and _KHMER_NAME.match(text, end)) or None
            if m and (_ENDS.match(text, m.end(1)) or "ក" <= word[0] <= "៿"):
                found.append(m.span(1))
    for start, end, kind in spans:
        if kind in ("phone", "address"):
            head = text[max(0, start - 50) : start]
            if m := re.search(r"((?:[A-Z]\.\s?)?[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,})?)(?:\s-\s|\s\(|,\s)$", head):
                found.append((max(0, start - 50) + m.start(1), max(0, start - 50) + m.end(1)))
        if kind == "phone" and (m := re.match(r"\s\(((?:[A-Z]\.\s?)?[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,})?)\)", text[end : end + 60])):
            found.append((end + m.start(1), end + m.end(1)))
    out = []
    for start, end in found:
        if text[start:end].split()[0].lower().rstrip(".") in _NO_NAMES:
            continue
        if all(end <= s or start >= e for s, e, _ in spans):
            out.append((start, end))
    return out


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _plain_words(text: str) -> list[str]:
    """The words of _words in small letters, without their places: much faster."""
    return text.lower().translate(_PARTS).split() if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def learn_terms(texts: DataFrame) -> DataFrame:
    """(term, n_protected, n_total) of every term that stands in a protected position.

    The row under "" holds the number of all words that are protected, and of all words.

    texts: a column ``text``. Counts cover all texts and are summed per task before the
    shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, protected, n = Counter(), Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                n += 1
                words = _plain_words(text)
                total.update(words)
                seen = set(words)
                places = [] if _TRIGGERS.isdisjoint(seen) else _words(text)
                for s, e in cued_names(text, places, fixed_details(text, seen)[1]):
                    protected.update(w.lower() for w, _, _ in _words(text[s:e]) if len(w) > 1)
            if len(total) > 500_000:
                yield _counts(total, protected, n)
                total, protected, n = Counter(), Counter(), 0
        yield _counts(total, protected, n)

    sums = texts.select("text").mapInPandas(count, "term string, n_protected long, n_total long").groupBy("term").agg(F.sum("n_protected").alias("n_protected"), F.sum("n_total").alias("n_total"))
    return sums.where("n_protected > 0 or term = ''")


def _counts(total: Counter, protected: Counter, n: int) -> pd.DataFrame:
    terms = list(total)
    return pd.DataFrame({"term": ["", *terms], "n_protected": [sum(protected.values()), *(protected[t] for t in terms)], "n_total": [sum(total.values()), *(total[t] for t in terms)]})


def revealing_terms(texts: DataFrame) -> DataFrame:
    """(term, bits) of the terms that disclose DISCLOSURE of the bits a protected position holds.

    ``bits`` is the pointwise mutual information of a term and protection; a position holds
    log2(words / protected words), what a term gives that stands in no other place.
    """
    counts = cut_lineage(learn_terms(texts))
    n_protected, n_words = counts.where("term = ''").agg(F.coalesce(F.sum("n_protected"), F.lit(0)), F.coalesce(F.sum("n_total"), F.lit(0))).first()
    held = F.log2(F.lit(float(n_words)) / F.lit(float(max(1, n_protected))))
    bits = held + F.log2(F.col("n_protected") / F.col("n_total"))
    return counts.where((F.col("term") != "") & (F.col("n_protected") >= LEAST)).select("term", bits.alias("bits")).where(F.col("bits") >= DISCLOSURE * held)


def sieve_of(terms: DataFrame) -> bytes:
    """A bit for each slot that a term falls into."""
    return slot_bits(terms.select(F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(SIEVE)).alias("slot")), SIEVE)


class Sieve:
    """Which words may be terms: all terms, and few others."""

    def __init__(self, packed: bytes) -> None:
        self.bits, self.seen = packed, {}

    def __contains__(self, word: str) -> bool:
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            slot = zlib.crc32(word.encode("utf-8", "replace")) % SIEVE
            hit = self.seen[word] = bool(self.bits[slot >> 3] >> slot % 8 & 1)
        return hit


Mark = tuple[str, int, int, int, bool, int]


def outline(text: str, likely) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]], list[Mark]]:
    """(spans of fixed form, names with a cue, marks of words that are ``likely`` terms).

    A mark is (word in small letters, its number, start, end, does it follow the word before
    with only blanks between?, start with an initial before it).
    """
    seen = set(_plain_words(text))
    _, spans = fixed_details(text, seen)
    hits = {w for w in seen if w in likely}
    words = _words(text) if hits or not _TRIGGERS.isdisjoint(seen) else []
    marks = []
    for i, (word, start, end) in enumerate(words if hits else ()):
        if word.lower() in hits:
            gap = text[words[i - 1][2] : start] if i else ""
            initial = _INITIAL.search(text, max(0, start - 4), start)
            marks.append((word.lower(), i, start, end, gap.isspace() and "\n" not in gap, initial.start() if initial else start))
    return spans, cued_names(text, words, spans), marks


def finish(spans: list[tuple[int, int, str]], names: list[tuple[int, int]], known: list[Mark]) -> list[tuple[str, int, int]]:
    """(type, start, end) of every detail, in order, from an outline whose marks are known terms."""
    spans, names = list(spans), list(names)
    run: list[int] = []  # start, end, number of the last word, words
    for _, i, start, end, follows, head in sorted(known, key=lambda m: m[1]):
        if run and follows and i == run[2] + 1 and run[3] < 2:
            run[1:] = [end, i, run[3] + 1]
            continue
        if run:
            names.append((run[0], run[1]))
        run = [head, end, i, 1]
    if run:
        names.append((run[0], run[1]))
    for s, e in sorted(names, key=lambda x: (x[0] - x[1], x[0])):  # the longest name wins
        if all(e <= a or s >= b for a, b, _ in spans):
            spans.append((s, e, "name"))
    return sorted(((k, s, e) for s, e, k in spans), key=lambda x: x[1])


def details(text: str | None, terms) -> list[tuple[str, int, int]]:
    """(type, start, end) of every detail of one text, ``terms`` being names. Null has none."""
    return finish(*outline(text, terms)) if text else []


def _details(given: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, field_name, found array<int>) of texts (key, field_name, text) that hold details.

    found: number of the type, start and end of each detail. Words that pass the sieve are
    looked up in the table of terms by a join, and meet again by text: few words a text.
    """
    held = given.sparkSession.sparkContext.broadcast(sieve_of(terms))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likely = Sieve(held.value)
        for batch in batches:
            out = []
            for key, field, text in zip(batch["key"], batch["field_name"], batch["text"], strict=True):
                spans, names, marks = outline(text, likely)
                if spans or names or marks:
                    out.append((key, field, zlib.crc32(text.encode("utf-8", "replace")), [v for s, e, k in spans for v in (TYPES.index(k), s, e)], [v for n in names for v in n], [f"{m[0]} {m[1]} {m[2]} {m[3]} {int(m[4])} {m[5]}" for m in marks]))
            yield pd.DataFrame(out, columns=["key", "field_name", "h", "spans", "names", "marks"])

    drawn = given.where("key is not null and text <> ''").mapInPandas(draw, "key string, field_name string, h long, spans array<int>, names array<int>, marks array<string>")
    one = drawn.select("key", "field_name", "h", "spans", "names", F.explode_outer("marks").alias("mark"))
    # a row without a mark gets a term that is none, of its own
    one = one.withColumn("term", F.coalesce(F.split("mark", " ")[0], F.concat(F.lit(" "), "key")))
    met = one.join(terms.select("term", F.lit(True).alias("is_term")), "term", "left")
    whole = met.groupBy("key", "field_name", "h").agg(F.max("spans").alias("spans"), F.max("names").alias("names"), F.collect_set(F.when(F.col("is_term"), F.col("mark"))).alias("marks"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for spans, names, marks in zip(batch["spans"], batch["names"], batch["marks"], strict=True):
                spans, names = [int(v) for v in spans], [int(v) for v in names]
                known = [(w, int(i), int(s), int(e), f == "1", int(h)) for w, i, s, e, f, h in (m.split(" ") for m in marks)]
                found = finish([(spans[i + 1], spans[i + 2], TYPES[spans[i]]) for i in range(0, len(spans), 3)], list(zip(names[::2], names[1::2], strict=True)), known)
                out.append([v for k, s, e in found for v in (TYPES.index(k), s, e)])
            yield pd.DataFrame({"key": batch["key"], "field_name": batch["field_name"], "found": out})

    return whole.mapInPandas(close, "key string, field_name string, found array<int>").where(F.size("found") > 0)


def find_details(rows: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """One row (key, field_name, pii_type, span_start, span_end) for each detail of each field.

    Whole texts are read. Null and empty texts have no rows, null keys neither. A key's rows
    that repeat give each detail once.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("f")
    given = rows.select(F.col(key).cast("string").alias("key"), each).select("key", "f.field_name", "f.text")
    at = F.sequence(F.lit(0), F.size("found") - 1, F.lit(3))
    one = _details(given, terms).select("key", "field_name", F.explode(F.transform(at, lambda i: F.slice("found", i + 1, 3))).alias("d"))
    kind = F.array(*[F.lit(t) for t in TYPES])[F.col("d")[0]]
    return one.select("key", "field_name", kind.alias("pii_type"), F.col("d")[1].alias("span_start"), F.col("d")[2].alias("span_end")).distinct()


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(rows: DataFrame, fields: list[str], terms: DataFrame) -> DataFrame:
    """``rows`` with each field's details generalised to placeholders such as [PHONE]; null stays null.

    Details are found once for each different text and joined back by a digest of the text.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(texts, found, strict=True):
            at = [] if at is None else [int(v) for v in at]
            out.append(redact(text, [(TYPES[at[i]], at[i + 1], at[i + 2]) for i in range(0, len(at), 3)]))
        return pd.Series(out, dtype=object)

    digest = lambda f: F.sha2(F.col(f), 256)
    texts = rows.select(F.explode(F.array(*fields)).alias("text")).where("text <> ''").select(digest("text").alias("key"), F.lit("").alias("field_name"), "text")
    found = _details(texts, terms).groupBy("key").agg(F.max("found").alias("found"))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    for i, f in enumerate(fields):
        packed = packed.withColumn("key", digest(f"row.`{f}`")).join(found.withColumnRenamed("found", f"found_{i}").hint("merge"), "key", "left").drop("key")
    return packed.select(*[clean(F.col(f"row.`{c}`"), F.col(f"found_{fields.index(c)}")).alias(c) if c in fields else F.col(f"row.`{c}`").alias(c) for c in rows.columns])
