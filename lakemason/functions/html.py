"""Fields out of HTML and nested JSON, by Arrow batches over the standard library's parsers."""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemason.functions.text import blank_to_null

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template".split())


class _Tree(HTMLParser):
    """Blocks of text with their tag and class; pairs of label and value; headings; meta values."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str]] = []
        self.cells: list[tuple[str, str, str]] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta" and given.get("content"):
            self.meta.setdefault(given.get("property") or given.get("name") or "", given["content"])
        if tag not in VOID:
            self.path.append((tag, given.get("class") or ""))
            if tag not in SKIPPED:
                self.cells.append((tag, given.get("class") or "", ""))

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                break

    def handle_data(self, data):
        if self.path and self.path[-1][0] in SKIPPED:
            return
        text = " ".join(data.split())
        if text and self.cells:
            tag, cls, so_far = self.cells[-1]
            self.cells[-1] = (tag, cls, f"{so_far} {text}".strip())


def parse(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    return tree


def label_pairs(html: str | None) -> dict[str, str]:
    """label -> value from dt/dd, th/td, td/td and label/value classes; the first of a label wins."""
    cells = [(t, c, x) for t, c, x in parse(html).cells if x]
    out: dict[str, str] = {}
    for (tag, cls, label), (tag2, cls2, value) in zip(cells, cells[1:], strict=False):
        pair = (tag, tag2) in {("dt", "dd"), ("th", "td"), ("td", "td")} or ("label" in cls and "value" in cls2)
        if pair and len(label) <= 60:
            out.setdefault(label.rstrip(" :："), value)
    return out


def page_title(html: str | None) -> str | None:
    tree = parse(html)
    for wanted in ("h1", "title"):
        text = next((x for t, _, x in tree.cells if t == wanted and x), None)
        if wanted == "h1" and text is None:
            text = tree.meta.get("og:title")
        if text:
            return text
    return None


def best_description(html: str | None, noise: tuple[str, ...] = ("cookie", "copyright", "subscribe", "login", "sign up")) -> str | None:
    """The block that reads most like a description: long, in sentences, few noise words."""
    def worth(x: str) -> float:
        return min(len(x), 4000) + 40 * len(re.findall(r"[.!?។。]", x)) - 400 * sum(n in x.lower() for n in noise)

    blocks = [x for t, _, x in parse(html).cells if t in {"p", "div", "section", "article", "td"} and len(x) >= 40]
    best = max(blocks, key=worth, default=None)
    return best if best is not None and worth(best) > 0 else None


def find_records(text: str | None, needed: str = "price", hints: tuple[str, ...] = ("title", "bedrooms", "size", "url", "id"), depth: int = 25) -> list[str]:
    """JSON texts of the outermost objects that look like a record: the needed key and two hints or more."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return []
    found: list[str] = []
    stack = [(root, 0)]
    while stack:
        node, level = stack.pop()
        if level > depth:
            continue
        if isinstance(node, dict):
            if needed in node and sum(h in node for h in hints) >= 2:
                found.append(json.dumps(node, ensure_ascii=False, sort_keys=True))
                continue
            stack += [(v, level + 1) for v in reversed(list(node.values()))]
        elif isinstance(node, list):
            stack += [(v, level + 1) for v in reversed(node)]
    return found


def flatten_value(text: str | None) -> str | None:
    """A readable text of a JSON value: itself, or its name, title, en, label or slug, or its first element's."""
    try:
        node = json.loads(text) if text else None
    except ValueError:
        return text
    while isinstance(node, dict | list):
        node = (node[0] if node else None) if isinstance(node, list) else next((node[k] for k in ("name", "title", "en", "label", "slug") if node.get(k)), None)
    return None if node is None else str(node)


def _batched(function, kind: T.DataType):
    return F.pandas_udf(lambda s: pd.Series([function(x) for x in s], dtype=object), kind)


def pairs_column(html: Column) -> Column:
    return _batched(lambda x: [{"label": k, "value": v} for k, v in label_pairs(x).items()], T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())])))(html)


def title_column(html: Column) -> Column:
    return _batched(page_title, T.StringType())(html)


def description_column(html: Column) -> Column:
    return _batched(best_description, T.StringType())(html)


def records_column(text: Column) -> Column:
    return _batched(find_records, T.ArrayType(T.StringType()))(text)


def embedded_json(html: Column, script_id: str) -> Column:
    """The JSON text of a script element by its id."""
    return blank_to_null(F.trim(F.regexp_extract(html, rf"(?is)<script[^>]*id=[\"']{script_id}[\"'][^>]*>(.*?)</script>", 1)))


def json_ld(html: Column) -> Column:
    """All JSON-LD blocks of a page."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def links(html: Column, base: str) -> Column:
    """Distinct link targets in page order, made absolute."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a[^>]*href=[\"']([^\"'#]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.when(u.rlike("^[a-z][a-z0-9+.-]*:"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(u, "^/+", "")))))


def plain_text(html: str | None) -> str | None:
    return None if html is None else unescape(" ".join(x for _, _, x in parse(html).cells if x))


def best_record(text: str | None, weights: dict[str, int], least: int = 20, depth: int = 25) -> str | None:
    """The JSON text of the object whose keys weigh most, from ``least`` on; the first on ties."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return None
    best, worth = None, least - 1
    stack = [(root, 0)]
    while stack:
        node, level = stack.pop()
        if level > depth:
            continue
        if isinstance(node, dict):
            total = sum(w for k, w in weights.items() if node.get(k) not in (None, "", [], {}))
            if total > worth:
                best, worth = node, total
        if isinstance(node, dict | list):
            stack += [(v, level + 1) for v in reversed(list(node.values()) if isinstance(node, dict) else node)]
    return None if best is None else json.dumps(best, ensure_ascii=False, sort_keys=True)


def page_records(html: str | None) -> tuple[str, list[str]]:
    """(method, records): from embedded JSON, else from label pairs, else nothing; the method is named."""
    for block in re.findall(r"(?is)<script[^>]*(?:application/(?:ld\+)?json|id=[\"']__NEXT_DATA__)[^>]*>(.*?)</script>", html or ""):
        found = find_records(block)
        if found:
            return "json", found
    pairs = label_pairs(html)
    return ("pairs", [json.dumps(pairs, ensure_ascii=False, sort_keys=True)]) if pairs else ("none", [])


def page_records_column(html: Column) -> Column:
    kind = T.StructType([T.StructField("method", T.StringType()), T.StructField("records", T.ArrayType(T.StringType()))])
    return F.pandas_udf(lambda s: pd.DataFrame([page_records(x) for x in s], columns=["method", "records"]), kind)(html)


def first_price(html: Column) -> Column:
    """A page's price: JSON-LD, then meta tags, then the largest amount beside a currency sign in the body."""
    ld = F.regexp_extract(html, r"(?is)application/ld\+json[^>]*>.*?\"price\"\s*:\s*\"?([0-9.]+)", 1).try_cast("double")
    meta = F.regexp_extract(html, r"(?is)<meta[^>]*(?:price:amount|itemprop=[\"']price)[^>]*content=[\"']([0-9.]+)", 1).try_cast("double")
    body = F.transform(F.regexp_extract_all(F.regexp_replace(html, "(?is)<script.*?</script>|<[^>]*>", " "), F.lit(r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda v: F.regexp_replace(v, ",", "").try_cast("double"))
    return F.coalesce(ld, meta, F.array_max(body))


def spec_map(specs: Column) -> Column:
    """type -> label from a JSON list of specifications [{type, label, shortLabel}], the first of a type wins."""
    parsed = F.filter(F.from_json(specs, "array<struct<type: string, label: string, shortLabel: string>>"), lambda s: s["type"].isNotNull())
    firsts = F.filter(parsed, lambda s, i: F.array_position(F.transform(parsed, lambda x: x["type"]), s["type"]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda s: F.struct(s["type"], F.coalesce(s["label"], s["shortLabel"]))))
