"""Sentence units of texts in many languages and scripts, as offsets.

Method: a pushdown automaton over the few characters that can matter. Opening quotation
marks and brackets are pushed, closing ones popped; terminators end a unit only with nothing
open, closers after them belong to the unit; a trie of abbreviations, read backwards from a
full stop, tells abbreviations from ends; list lines and headings stand for themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that a name, number or object always follows...
BEFORE = "dr mr mrs ms messrs prof mme mlle me mgr rev hon gen col capt sgt fig figs vol vols art arts pp p cf vs approx env bd sq ca al ch sec ed eds tel ext app dept e.g i.e".split()
# ...such as stand before a number, words otherwise...
NUMBERED = "no nos nr".split()
# ...and such as may stand last in a sentence.
LAST = "st ave rd blvd mt ft ltd co inc corp jr sr etc a.m p.m ph.d b.a m.a b.c a.d est dist prov km m cm kg bros jan feb mar apr jun jul aug sep sept oct nov dec".split()
COUNTRIES = "u.s u.k u.n e.u u.s.a d.c".split()

OPENERS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
CLOSERS = frozenset("”»」』›)）]】》")
BRACKETS = frozenset("(（[【《")
STRONG = frozenset("!?！？。។៕॥।؟")
_EVENT = re.compile(r"\n|[.!?。！？។៕…॥।؟]+|[\"“”«»„「」『』‹›()（）\[\]【】《》]")
_LIST = re.compile(r"(?:[-•*–·▪◦]|\d{1,3}[.)]|[A-Za-z]\)|\((?:\d{1,2}|[a-z])\)|[ivx]{1,4}\))[ \t]+(?=\S)")
_SPACE = re.compile(r"[\s\u200b\ufeff]*")
_ADDRESS = re.compile(r"www\.|://|@")
_SAID = re.compile("问|说|道|答|喊|叫|asked|said|wrote|replied")
_SMALL_START, _CAPITAL_START = (re.compile(rf"[a-z]{{3,}}\.\s+[{c}]") for c in ("a-z", "A-Z"))
_GOES_ON = frozenset("and or but to until till on in every for at as by daily sharp when while if".split())


def starts_word(text: str, i: int) -> bool:
    """Does a word start at ``i``? Behind a full stop only where that one ended a sentence."""
    if i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "."):
        return True
    return text[i - 1] == "." and i > 2 and (text[i - 2].isdigit() or (text[i - 2].isalpha() and text[i - 3].isalpha()))


class Trie:
    """Words by their letters from the last to the first."""

    def __init__(self, groups: dict[str, list[str]]) -> None:
        self.root: dict = {}
        for kind, words in groups.items():
            for word in words:
                node = self.root
                for ch in reversed(word):
                    node = node.setdefault(ch, {})
                node[""] = kind

    def before(self, text: str, end: int) -> str | None:
        """The kind of the longest whole abbreviation that ends at ``end``."""
        node, i, found = self.root, end, None
        while i > 0 and text[i - 1].lower() in node:
            i -= 1
            node = node[text[i].lower()]
            if "" in node and starts_word(text, i):
                found = node[""]
        return found


ABBREVIATIONS = Trie({"before": BEFORE, "numbered": NUMBERED, "last": LAST, "country": COUNTRIES})


def _khmer(ch: str) -> bool:
    return "ក" <= ch <= "៿"


def _wide(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿"


class Automaton:
    """One run over one text."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, len(text)
        # a text in small letters: its sentences begin with them too
        self.small = len(_SMALL_START.findall(text)) > len(_CAPITAL_START.findall(text)) or not any(c.isupper() for c in text)
        self.units: list[tuple[int, int]] = []
        self.open: list[tuple[str, bool]] = []  # closing marks awaited, and: opened at the unit's start?
        self.start = 0
        self.in_list = False
        self.token = (0, 0, False)  # the last run without blanks: start, end, is it an address?

    def run(self) -> list[tuple[int, int]]:
        self._begin(0)
        at = self.start
        while at < self.size and (m := _EVENT.search(self.text, at)):
            i, j = m.span()
            ch = m.group()[0]
            if ch == "\n":
                at = self._line_break(i)
            elif ch in STRONG or ch in ".…":
                at = j if self.in_list else self._terminator(i, j)
            else:
                self._mark(ch, i)
                at = j
            at = max(at, i + 1)
        self._end(self.size)
        return self.units

    def _begin(self, at: int) -> None:
        self.start = _SPACE.match(self.text, at).end()
        self.open.clear()
        self.in_list = self._line_starts(self.start) and bool(_LIST.match(self.text, self.start))

    def _end(self, at: int) -> int:
        """Close the unit before ``at``; the next begins at the next that is no blank."""
        end = at
        while end > self.start and (self.text[end - 1].isspace() or self.text[end - 1] in "\u200b\ufeff"):
            end -= 1
        if end > self.start:
            self.units.append((self.start, end))
        self._begin(at)
        return self.start

    def _mark(self, ch: str, i: int) -> None:
        first = i == self.start
        if ch == '"':
            awaited = [k for k, (c, _) in enumerate(self.open) if c == '"']
            if awaited:
                del self.open[awaited[0] :]
            else:
                self.open.append(('"', first))
        elif ch in OPENERS and not any(ch in c for c, _ in self.open):
            self.open.append((OPENERS[ch], first))
        else:
            for k in range(len(self.open) - 1, -1, -1):
                if ch in self.open[k][0]:
                    del self.open[k:]
                    break

    def _line_break(self, i: int) -> int:
        text = self.text
        if i < self.start:
            return self.start
        next_at = _SPACE.match(text, i).end()
        before = i
        while before > self.start and text[before - 1].isspace():
            before -= 1
        if before <= self.start or next_at >= self.size:
            return self._end(i)
        prev, ahead = text[before - 1], text[next_at]
        if text.count("\n", before, next_at) > 1 or _LIST.match(text, next_at):
            return self._end(i)
        if self.in_list:
            return next_at if ahead.islower() else self._end(i)
        if _khmer(prev) or _khmer(ahead) or (prev in STRONG and not self.open):
            return self._end(i)
        if ahead.isupper() and not self.open and prev not in ",;:-–—" and prev.isalnum() and before - self.start < 40 and self._line_starts(self.start):
            return self._end(i)  # a short first line without an end: a heading
        return next_at

    def _line_starts(self, at: int) -> bool:
        while at and self.text[at - 1] in " \t\r":
            at -= 1
        return not at or self.text[at - 1] == "\n"

    def _terminator(self, i: int, j: int) -> int:
        text, run = self.text, self.text[i:j]
        if run[0] == "។" and self._and_so_on(i):
            return j
        strong = any(c in STRONG for c in run)
        if not strong and not (self._ellipsis(j) if len(run) > 1 or run == "…" else self._full_stop(i)):
            return j
        depth, popped = len(self.open), []
        k = j
        while k < self.size:
            ahead = k
            if text[k] in " \u00a0\u202f" and k + 1 < self.size and text[k + 1] == "»" and self.open and self.open[-1][0] == "»":
                ahead = k + 1
            c = text[ahead]
            at = next((n for n in range(len(self.open) - 1, -1, -1) if c in self.open[n][0]), None)
            if at is None or not (c == '"' or c in CLOSERS or c == "“"):
                break
            popped.append(self.open[at])
            del self.open[at:]
            k = ahead + 1
        if self.open:
            return k
        if popped and not self._after_closer(k, popped[-1], run):
            return k
        if not popped and depth == 0 and text[k : k + 1] in (",", ";", "，", "、"):
            return k
        while k < self.size and text[k] in CLOSERS:  # a closer that nothing opened
            k += 1
        return self._end(k)

    def _and_so_on(self, i: int) -> bool:
        """Is this mark part of the Khmer "and so on", with text to follow?"""
        text = self.text
        if text[i + 1 : i + 3] == "ល។":
            return True
        if text[max(0, i - 2) : i] != "។ល":
            return False
        line = text.find("\n", i)
        return bool(text[i + 1 : line if line >= 0 else self.size].strip())

    def _after_closer(self, k: int, mark: tuple[str, bool], run: str) -> bool:
        """Does a unit end behind closers that follow a terminator?"""
        text, (close, first) = self.text, mark
        n = _SPACE.match(text, k).end()
        if n >= self.size or text.count("\n", k, n) > 1:
            return True
        ahead = text[n]
        if ahead in ",;:，、；：.。។":
            return False
        if close in ")）]】》":
            return first or not ahead.islower()
        if _LIST.match(text, n) and "\n" in text[k:n]:
            return True
        asks = run[-1] in "?!？！"
        if ahead.islower():
            return self.small and not (first and asks)
        if _wide(ahead):
            return not (first and asks and _SAID.search(text, n, n + 12))
        return True

    def _ellipsis(self, j: int) -> bool:
        n = _SPACE.match(self.text, j).end()
        if n >= self.size or self.text.count("\n", j, n) > 1:
            return True
        ahead = self.text[n]
        return ahead in '"”»)' or (n > j and ahead.isupper())

    def _full_stop(self, i: int) -> bool:
        text = self.text
        prev, after = text[i - 1 : i], text[i + 1 : i + 2]
        if not after:
            return not _khmer(prev)
        if _khmer(prev):
            return False
        closes = after in CLOSERS or (after == '"' and any(c == '"' for c, _ in self.open))
        if not (after.isspace() or closes):
            return self._glued(i, prev, after)
        n = i + 1
        while n < self.size and (text[n].isspace() or text[n] in "\"”»)]’'"):
            n += 1
        if n >= self.size or text.count("\n", i, n) > 1:
            return True
        ahead = text[n]
        kind = ABBREVIATIONS.before(text, i)
        if kind == "before":
            return False
        if kind == "numbered":
            return not ahead.isdigit()
        if kind == "country":
            return False
        lone = prev.isalpha() and starts_word(text, i - 1)
        if kind == "last" and not (lone and prev.isupper()):
            if self.small:
                return text[max(0, i - 3) : i] in ("a.m", "p.m") and text[n : n + 9].split()[0].strip(",.;") not in _GOES_ON
            return not (ahead.islower() or ahead.isdigit() or ahead in ",;:")
        if lone and not prev.isdigit():
            return False  # an initial
        if ahead in ",;:":
            return False
        return self.small or not ahead.islower()

    def _glued(self, i: int, prev: str, after: str) -> bool:
        """A full stop without a blank behind it: an end where two sentences were run together."""
        text = self.text
        if (prev.isdigit() and after.isdigit()) or not (prev.isalnum() or prev in ")”\"»%"):
            return False
        lo, hi, address = self.token
        if not lo <= i < hi:
            lo, hi = i, i
            while lo > 0 and not text[lo - 1].isspace():
                lo -= 1
            while hi < self.size and not text[hi].isspace():
                hi += 1
            address = bool(_ADDRESS.search(text, lo, hi))
            self.token = lo, hi, address
        if address or ABBREVIATIONS.before(text, i) in ("before", "numbered", "country"):
            return False
        if _wide(after) or _khmer(after) or after in '"“«(':
            return True
        two = prev.isdigit() or prev in ")%" or text[i - 2 : i].isalpha()
        if after.isupper():
            return two and (text[i + 2 : i + 3].islower() or text[i + 2 : i + 3].isspace())
        return self.small and after.islower() and text[i - 3 : i].isalpha() and text[i + 1 : i + 3].isalpha() and text.find(".", lo, i) < 0


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit in code points; none for null, empty and blank texts."""
    return Automaton(text).run() if text and not text.isspace() else []


def sentence_units(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, sent_start, sent_end) for each unit of each text.

    Offsets are code points from 0, the end is exclusive, blanks and line breaks around a
    unit are left out; all other characters belong to exactly one unit. Whole texts are
    read, one at a time; null, empty and blank texts have no rows. Rows repeated under one
    key repeat their units.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, s, e) for k, t in zip(batch["key"].tolist(), batch["text"], strict=True) for s, e in sentences(t)]
            yield pd.DataFrame(out, columns=["key", "sent_start", "sent_end"])

    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return given.mapInPandas(split, f"key {dict(given.dtypes)['key']}, sent_start long, sent_end long").withColumnRenamed("key", key)
